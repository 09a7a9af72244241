"""Language identification by cross-parsing entropy.

Training: a suffix automaton for each language over a bounded sample of its
labelled texts (``train_chars`` characters).  Prediction: a text is cut greedily
into phrases, each the longest match that starts there and occurs in the training
text; the walk through the automaton yields those match lengths.  The language
that needs the fewest phrases for each character, times the log of its training
length (bits a character, a text's cross-parsing cost), wins.

A filter rejects texts that no language fits: those whose winner needs far more phrases a
character than training texts that were held back from the automata (``Model.limit``).

Every letter of the training texts has a symbol of its own.  The automata are
sparse: the transitions of all states lie interleaved in one pair of arrays (row
displacement), so their size goes by the training text and not by the alphabet.  A
missing transition restarts at the root and counts a phrase.  All
documents of a batch step together, longest first; once few are left the rest of
each is walked in plain Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import count as numbers

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import give_back, tidy

UNKNOWN = "und"
_OTHER = 1  # symbol of characters that training doesn't hold
_LANES = 48


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a symbol sequence; state 0 is the root."""
    after: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new, p = len(after), last
        after.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(after)
                after.append(dict(after[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return after


def displaced(states: list[dict[int, int]], width: int) -> tuple[list[int], int]:
    """(base of each state, size): ``base + symbol`` is a place of no other transition; bases differ."""
    base, taken, used = [0] * len(states), set(), bytearray(2 * width + 2)
    low, single = 0, False
    for s in sorted(range(len(states)), key=lambda i: -len(states[i])):
        moves = sorted(states[s])
        if not moves:
            at = next(x for x in numbers() if x not in taken)
        else:
            if len(moves) == 1 and not single:
                low, single = 0, True
            place, tries = used.find(0, low), 0
            while True:
                at = place - moves[0]
                if len(used) <= place + width + 1:
                    used.extend(bytes(len(used)))
                if at >= 0 and at not in taken and not any(used[at + m] for m in moves):
                    break
                place, tries = used.find(0, place + 1), tries + 1
            if tries > 64 or (single and not tries):
                low = place
            for m in moves:
                used[at + m] = 1
        base[s] = at
        taken.add(at)
    return base, max(taken) + width


@dataclass
class Model:
    languages: list[str]
    symbols: np.ndarray  # code point -> symbol
    owner: np.ndarray  # base of the state whose transition lies here; a state is known by its base
    target: np.ndarray  # the next state's base
    again: np.ndarray  # (symbols, languages): where a missing transition leads
    roots: np.ndarray
    lengths: np.ndarray
    limit: float = 0.5  # phrases a character from which no language fits


def simplify(text: str) -> str:
    """Letters lower-cased; every run of other characters becomes one blank."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def _codes(texts: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]


_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER[ord("a")]:
        _LETTER[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return _LETTER


def _share(sizes: list[int], most: int) -> int:
    """The largest part of each text such that no more than ``most`` characters are taken together."""
    part = most
    for k, n in enumerate(sorted(sizes)):
        part = most // (len(sizes) - k)
        if n > part:
            break
        most -= n
    return part


def fit(samples: dict[str, list[str]], train_chars: int) -> Model:
    """The model of texts by language, at most ``train_chars`` characters for each language, spread over its texts."""
    training: dict[str, str] = {}
    for language, texts in sorted(samples.items()):
        parts = [" " + simplify(text) for text in texts]
        share = _share([len(x) for x in parts], train_chars)
        training[language] = ("".join(x[:share] for x in parts) + " ")[:train_chars]
    letters = sorted({c for t in training.values() for c in t if c != " "})
    symbols = np.full(0x110000, _OTHER, np.int32)
    symbols[~_letters()] = 0
    for i, c in enumerate(letters):
        symbols[ord(c)] = i + 2
    width = len(letters) + 2
    owners, targets, roots, size = [np.full(1, -1, np.int32)], [np.zeros(1, np.int32)], [], 1
    again = np.zeros((width, len(training)), np.int32)
    for g, text in enumerate(training.values()):
        states = suffix_automaton(symbols[_codes([text])[0]].tolist())
        base, more = displaced(states, width)
        owner, target = np.full(more, -1, np.int32), np.zeros(more, np.int32)
        for s, moves in enumerate(states):
            for c, to in moves.items():
                owner[base[s] + c] = base[s] + size
                target[base[s] + c] = base[to] + size
        again[:, g] = base[0] + size
        for c, to in states[0].items():
            again[c, g] = base[to] + size
        owners.append(owner)
        targets.append(target)
        roots.append(base[0] + size)
        size += more
    lengths = np.array([len(t) for t in training.values()], float)
    return Model(list(training), symbols, np.concatenate(owners), np.concatenate(targets), again, np.array(roots, np.int32), lengths)


def phrases(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """(texts, languages): phrases of each symbol sequence under each automaton."""
    langs = len(model.languages)
    out = np.zeros((len(texts), langs), np.int64)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order])
    longest = int(sizes[0]) if len(sizes) else 0
    state = np.repeat(model.roots[None, :], len(order), 0)
    count = np.zeros((len(order), langs), np.int32)
    begin = np.cumsum(sizes) - sizes
    flat = np.concatenate([texts[i] for i in order]) if longest else np.zeros(0, np.int32)
    active = np.searchsorted(-sizes, -np.arange(longest), "left")  # documents longer than t
    t = 0
    while t < longest and active[t] > _LANES:
        n = int(active[t])
        now, seen = state[:n], flat[begin[:n] + t]
        at = now + seen[:, None]
        lost = model.owner.take(at) != now
        count[:n] += lost
        state[:n] = np.where(lost, model.again.take(seen, axis=0), model.target.take(at))
        t += 1
    if t < longest:
        owner, target = memoryview(model.owner), memoryview(model.target)
        again = [memoryview(np.ascontiguousarray(model.again[:, g])) for g in range(langs)]
        for d in range(int(active[t])):
            rest = flat[begin[d] + t : begin[d] + sizes[d]].tolist()
            for g in range(langs):
                s, found, restart = int(state[d, g]), 0, again[g]
                for c in rest:
                    if owner[s + c] == s:
                        s = target[s + c]
                    else:
                        s = restart[c]
                        found += 1
                count[d, g] += found
    out[order] = count + (sizes > 0)[:, None]
    return out


def _sequences(model: Model, texts: list[str]) -> list[np.ndarray]:
    out = []
    for text in texts:
        codes = model.symbols[_codes([text.lower()])[0]]
        blank = codes == 0
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        out.append(codes[keep])
    return out


def parsed(model: Model, texts: list[str], most_chars: int = 8 << 20) -> list[tuple[str, float, int, int]]:
    """(predicted language, confidence, symbols, phrases under the winner) of each text.

    Confidence is the winner's margin to the runner-up in bits for each character, squashed to 0..1.  Without
    letters ``und`` and 0.
    """
    if len(texts) > 1 and sum(map(len, texts)) > most_chars:  # halves, so that no array of a whole large batch is made
        half = len(texts) // 2
        return parsed(model, texts[:half], most_chars) + parsed(model, texts[half:], most_chars)
    sequences, out = _sequences(model, texts), []
    for seq, n in zip(sequences, phrases(model, sequences)):
        if not (seq > 0).any() or not model.languages:
            out.append((UNKNOWN, 0.0, len(seq), 0))
            continue
        cost = n * np.log2(np.maximum(model.lengths, 2)) / len(seq)
        order = np.argsort(cost, kind="stable")
        sure = 1.0 if len(order) == 1 else float(1 - cost[order[0]] / cost[order[1]]) if cost[order[1]] else 0.0
        out.append((model.languages[order[0]], sure, len(seq), int(n[order[0]])))
    return out


def score(model: Model, texts: list[str], most_chars: int = 8 << 20) -> tuple[list[str], list[float]]:
    """Predicted language and confidence of each text."""
    found = parsed(model, texts, most_chars)
    return [x[0] for x in found], [x[1] for x in found]


def fits(model: Model, texts: list[str], slack: int = 4) -> list[bool]:
    """Whether some language fits: a letter, and no more phrases than the limit allows for the length and ``slack``
    more, by which texts too short to tell are kept."""
    return [name != UNKNOWN and n <= model.limit * size + slack for name, _, size, n in parsed(model, texts)]


def calibrated(model: Model, held: DataFrame, text_col: str, far: float = 2.0, least: int = 60, places: int = 10_000) -> Model:
    """The model with its limit at ``far`` times what 19 in 20 of all held-back texts of ``least`` symbols or more need, told
    to 1 / ``places`` of a phrase a character; without such texts it stays as it is.

    Every text counts; tasks send back how many texts need how much.
    """
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = parsed(shared.value, batch.column(0).to_pylist())
            rates = np.array([n / size for name, _, size, n in found if name != UNKNOWN and size >= least])
            cells, n = np.unique(np.ceil(rates * places).astype(np.int64), return_counts=True)
            yield pa.record_batch([pa.array(cells), pa.array(n, pa.int64())], names=["cell", "n"])
            give_back()

    counts = held.select(F.col(text_col).cast("string")).mapInArrow(tidy(run), "cell long, n long")
    cells = sorted(map(tuple, counts.groupBy("cell").agg(F.sum("n")).collect()))  # at most ``places`` + 1
    if not cells:
        return model
    up_to = np.cumsum([n for _, n in cells])
    return replace(model, limit=far * cells[int(np.searchsorted(up_to, 0.95 * up_to[-1]))][0] / places)


def train(labelled: DataFrame, text_col: str, lang_col: str, *, train_texts: int, train_chars: int, most_languages: int = 4096, limited: bool = True) -> Model:
    """Fits on about ``train_texts`` distinct texts for each language, chosen by hash.

    The sample is bounded for each language, by ``train_texts`` texts and ``train_chars``
    characters spread over them (beginnings, where the texts are longer); every language is learnt.  With ``limited`` all
    other labelled texts, whole ones, set the model's limit.  More than ``most_languages`` distinct labels raise: an automaton for each would not fit the driver.
    """
    text = F.col(text_col).cast("string")
    rows = labelled.where(F.col(lang_col).isNotNull() & text.isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(F.lit("langid"), text).alias("h"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} distinct languages in {lang_col}")
    if not counts:
        return fit({}, train_chars)
    limits = [(lang, int(min(1.0, 2 * train_texts / max(n, 1)) * (1 << 30)) + 1) for lang, n in counts]
    limit = F.broadcast(labelled.sparkSession.createDataFrame(limits, "lang string, below long"))
    drawn = rows.join(limit, "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("below")).dropDuplicates(["lang", "h"])
    sample = drawn.select("lang", F.substring("text", 1, train_chars), F.pmod("h", F.lit(1 << 30)), "h").collect()
    samples: dict[str, list[str]] = {}
    learnt: set[tuple[str, int]] = set()
    for lang, text, _, h in sorted(sample, key=lambda r: (r[0], r[2], r[1])):
        if len(samples.setdefault(lang, [])) < train_texts:
            samples[lang].append(text)
            learnt.add((lang, h))
    model = fit(samples, train_chars)
    if not limited:
        return model
    known = F.broadcast(labelled.sparkSession.createDataFrame(sorted(learnt), "lang string, h long"))  # at most ``train_texts`` a language
    return calibrated(model, rows.join(known, ["lang", "h"], "left_anti"), "text")


def identify(
    docs: DataFrame,
    trusted: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    *,
    train_texts: int = 64,
    train_chars: int = 24_000,
) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``, whole texts.

    Learns from rows where ``trusted`` holds and the language isn't null; the language
    is no input of a prediction.  Null texts and texts without a letter: ``und``, 0.
    Nothing to learn from: ``und`` for all.  Ties go to the language first in
    order of names.  Repeated rows are predicted alike.  An empty table gives no rows.
    """
    model = train(
        docs.where(F.coalesce(trusted, F.lit(False))), text_col, lang_col,
        train_texts=train_texts, train_chars=train_chars, limited=False,
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sure = score(shared.value, [x or "" for x in batch.column(1).to_pylist()])
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "lang_pred", "score"])
            give_back()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def fits_column(model: Model, docs: DataFrame):
    """A function that says of a text column, row by row, whether some language fits."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        found = pd.Series(fits(shared.value, [x or "" for x in texts]), dtype=bool)
        give_back()
        return found

    return run


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` modulo ``parts``; a null id does not."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.coalesce((F.crc32(text.cast("binary")) % parts == part) & F.col(id_col).isNotNull(), F.lit(False))
