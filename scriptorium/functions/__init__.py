"""Part of scriptorium; see the README for the layout."""
