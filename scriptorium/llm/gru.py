"""A gated recurrent language model in numpy with a class-factored output softmax.

A token is an output class and, in a head class, a member of it.  Tokens outside the
head belong to a rare class whose members share a fixed distribution, so only the
class of such a token is modelled.  Inputs: one embedding for each head token and one
for each rare class.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np

F32 = np.float32


@dataclass(frozen=True)
class Layout:
    """Inputs 0..head-1 are head tokens, head.. the rare classes."""

    head: int
    rare: int
    classes: np.ndarray  # class of every input
    member: np.ndarray  # place in its class
    sizes: np.ndarray  # members of every head class
    hidden: int = 24
    embedding: int = 16

    @property
    def inputs(self) -> int:
        return self.head + self.rare

    @property
    def groups(self) -> int:
        return len(self.sizes) + self.rare

    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def shapes(self) -> list[tuple[int, ...]]:
        h, e = self.hidden, self.embedding
        return [(self.inputs, e), (e, 3 * h), (h, 3 * h), (3 * h,), (h, self.groups), (self.groups,), (self.head, h), (self.head,)]


def initial(layout: Layout, class_log: np.ndarray, word_log: np.ndarray, seed: int = 5) -> list[np.ndarray]:
    """Parameters whose outputs equal the given unigram logs; members are ordered by class."""
    draw = np.random.default_rng(seed)
    shapes = layout.shapes()
    out = [draw.normal(0, s, shape).astype(F32) for shape, s in zip(shapes[:3], (0.1, 0.25, 0.2))]
    out += [np.zeros(shapes[3], F32), np.zeros(shapes[4], F32), class_log.astype(F32), np.zeros(shapes[6], F32), word_log.astype(F32)]
    return out


def flatten(parameters: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in parameters])


def _views(layout: Layout, flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for shape in layout.shapes():
        n = int(np.prod(shape))
        out.append(flat[at : at + n].reshape(shape))
        at += n
    return out


def restore(layout: Layout, flat: np.ndarray) -> list[np.ndarray]:
    return [v.astype(F32) for v in _views(layout, flat)]


class Room:
    """Float arrays by name, whose memory one window after another uses anew, so that the system doesn't clear it each time."""

    def __init__(self) -> None:
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.kept or len(self.kept[name]) < size:
            self.kept[name] = np.empty(size, F32)
        return self.kept[name][:size].reshape(shape)


def _shut(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), the sigmoid of -x, in place of ``x``."""
    with np.errstate(over="ignore"):  # an infinite exp stands for a gate that is shut
        np.exp(x, out=x)
    x += F32(1)
    return np.reciprocal(x, out=x)


def _flat(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether float32 holds every exp of these outputs as it is: states lie between -1 and 1."""
    return float((np.abs(weights).sum(axis=1) + np.abs(bias)).max(initial=0)) < 60


def _exp_rows(x: np.ndarray, flat: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """(sum of exp of each row, what each row was shifted by), ``x`` becoming the exp; no row is shifted if ``flat``."""
    top = None
    if not flat:
        top = x.max(axis=1)
        x -= top[:, None]
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], F32), top


#: Rows of class outputs that are worked on at once, so that they stay in a core's cache.
_ROWS = 1536


def output_log(
    layout: Layout, par: list[np.ndarray], states: np.ndarray, tokens: np.ndarray, grads: list[np.ndarray] | None = None, room: Room | None = None
):
    """Natural log probability of each token after its state; with ``grads``, also the
    gradient of the summed loss (added to ``grads``) with respect to the states.

    Of a softmax only exp and its sums are kept: the division by the sum is left to what is h wide.
    """
    wc, bc, wo, bo = par[4:]
    h, n, room = layout.hidden, len(tokens), room or Room()
    group = layout.classes[tokens]
    out, back = np.empty(n), None if grads is None else room("back", n, h)
    own = room("own", n, h + 1)  # states, and a one for the bias
    own[:, :h], own[:, h] = states, 1
    wide, flat = np.vstack([wc, bc]), _flat(wc.T, bc)
    starts = np.arange(_ROWS) * layout.groups
    by_group = None if grads is None else np.zeros((layout.groups, h + 1), F32)
    for at in range(0, n, _ROWS):
        rows = slice(at, min(n, at + _ROWS))
        chance = np.matmul(own[rows], wide, out=room("chance", rows.stop - at, layout.groups))
        spot = starts[: rows.stop - at] + group[rows]
        own_log = chance.ravel().take(spot)
        total, top = _exp_rows(chance, flat)
        out[rows] = own_log - (np.log(total) if top is None else np.log(total) + top)
        if grads is not None:
            every = chance.reshape(-1)
            every[spot] = every.take(spot) - total
            share = 1 / total
            by_group += chance.T @ (own[rows] * share[:, None])
            np.matmul(chance, wc.T, out=back[rows])
            back[rows] *= share[:, None]
    order = np.argsort(group.astype(np.int16), kind="stable")
    cut = np.searchsorted(group[order], np.arange(len(layout.sizes) + 1))
    order, cut = order[: cut[-1]], cut.tolist()
    inside, by_class = layout.member[tokens[order]], np.take(own, order, axis=0, out=room("by_class", len(order), h + 1), mode="clip")
    gain, total, shift = np.zeros(len(order), F32), np.ones(len(order), F32), None
    deep, flat = np.column_stack([wo, bo]), _flat(wo, bo)
    if not flat:
        shift = np.zeros(len(order), F32)
    if grads is not None:
        by_member, slope, share = np.zeros_like(deep), room("slope", len(order), h), np.empty((len(order), 1), F32)
    every_row, a = np.arange(len(order)), 0
    for g, size in enumerate(layout.sizes.tolist()):
        rows, span = slice(cut[g], cut[g + 1]), slice(a, a + size)
        a += size
        if cut[g] == cut[g + 1]:
            continue
        if size == 1:
            if grads is not None:
                slope[rows] = 0
            continue
        own_rows = by_class[rows]
        chance = own_rows @ deep[span].T
        every = chance.reshape(-1)
        spot = every_row[: len(chance)] * size
        spot += inside[rows]
        every.take(spot, out=gain[rows], mode="clip")
        sums, top = _exp_rows(chance, flat)
        total[rows] = sums
        if top is not None:
            shift[rows] = top
        if grads is not None:
            every[spot] = every.take(spot) - sums
            np.divide(1, sums, out=share[rows, 0])
            np.matmul(chance.T, own_rows * share[rows], out=by_member[span])
            np.matmul(chance, wo[span], out=slope[rows])
            slope[rows] *= share[rows]
    gain -= np.log(total)
    if shift is not None:
        gain -= shift
    out[order] += gain
    if grads is not None:
        grads[4] += by_group[:, :h].T
        grads[5] += by_group[:, h]
        grads[6] += by_member[:, :h]
        grads[7] += by_member[:, h]
        back[order] += slope
    return out, back


def lanes(texts: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, flat inputs, flat targets, sizes) with the longest text first; every text
    begins after ``start``."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    targets = np.concatenate([texts[i] for i in order]) if len(texts) else np.zeros(0, np.int32)
    inputs = np.empty_like(targets)
    inputs[1:] = targets[:-1]
    begin = np.cumsum(sizes) - sizes
    inputs[begin[sizes > 0]] = start
    return order, inputs, targets, sizes


def score(layout: Layout, par: list[np.ndarray], texts: list[np.ndarray], start: int, window: int = 16, most: int = 16384, width: int = 1024) -> np.ndarray:
    """Natural log probability of each whole text; the state runs on from window to window.

    Texts of like length run side by side, ``width`` at a time; where few are left a window is as much longer.
    """
    if len(texts) > width:
        out, order = np.zeros(len(texts)), np.argsort([len(t) for t in texts], kind="stable")
        for at in range(0, len(order), width):
            part = order[at : at + width]
            out[part] = score(layout, par, [texts[i] for i in part], start, window, most, width)
        return out
    order, inputs, targets, sizes = lanes(texts, start)
    begin, longest = np.cumsum(sizes) - sizes, int(sizes.max(initial=0))
    h = layout.hidden
    project = (par[0] @ par[1] + par[3]).astype(F32)
    # By gates; what a gate's sigmoid, 1 / (1 + exp(-x)), takes has the other sign.
    x_z, x_r, x_new = (np.ascontiguousarray(project[:, k * h : k * h + h] * F32(sign)) for k, sign in enumerate((-1, -1, 1)))
    h_z, h_r, h_new = (np.ascontiguousarray(par[2][:, k * h : k * h + h] * F32(sign)) for k, sign in enumerate((-1, -1, 1)))
    state = np.zeros((len(texts), h), F32)
    total = np.zeros(len(texts))
    active = np.searchsorted(-sizes, -np.arange(longest), "left")
    at = 0
    while at < longest:
        states, seen, owner = [], [], []
        to = min(longest, at + max(window, most // int(active[at])))
        for t in range(at, to):
            n = int(active[t])
            spot = begin[:n] + t
            given = inputs[spot]
            now = state[:n]
            z, r = now @ h_z, now @ h_r
            for gate, x in ((z, x_z), (r, x_r)):
                gate += x.take(given, axis=0)
                _shut(gate)
            new = now @ h_new
            new *= r
            new += x_new.take(given, axis=0)
            np.tanh(new, out=new)
            now -= new
            now *= z
            now += new
            states.append(now.copy())
            seen.append(targets[spot])
            owner.append(np.arange(n))
        at = to
        states_, seen_, owner_ = np.concatenate(states), np.concatenate(seen), np.concatenate(owner)
        for a in range(0, len(seen_), most):
            logs, _ = output_log(layout, par, states_[a : a + most], seen_[a : a + most])
            total += np.bincount(owner_[a : a + most], logs, len(texts))
    out = np.zeros(len(texts))
    out[order] = total
    return out


def deal(texts: list[np.ndarray], start: int, lanes_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, begins, live), each (steps, lanes): whole texts one after another in each lane.

    ``begins`` marks where a text begins after ``start`` with a state of its own, ``live``
    where a lane still has tokens.  Texts go, longest first, to the lane with the least.
    """
    load: list[tuple[int, int]] = [(0, k) for k in range(lanes_)]
    place: list[list[np.ndarray]] = [[] for _ in range(lanes_)]
    for text in sorted(texts, key=len, reverse=True):
        n, k = heapq.heappop(load)
        place[k].append(text)
        heapq.heappush(load, (n + len(text), k))
    steps = max((n for n, _ in load), default=0)
    inputs, targets = np.zeros((steps, lanes_), np.int32), np.zeros((steps, lanes_), np.int32)
    begins, live = np.zeros((steps, lanes_), bool), np.zeros((steps, lanes_), bool)
    for k, own in enumerate(place):
        at = 0
        for text in own[::-1]:
            if len(text):
                targets[at : at + len(text), k] = text
                inputs[at, k], inputs[at + 1 : at + len(text), k] = start, text[:-1]
                begins[at, k] = True
                at += len(text)
        live[:at, k] = True
    return inputs, targets, begins, live


def window_grads(
    layout: Layout, par: list[np.ndarray], state: np.ndarray, inputs: np.ndarray, targets: np.ndarray, begins: np.ndarray, live: np.ndarray, room: Room | None = None
):
    """(loss, tokens, gradients, last state) of one window of steps by lanes, backpropagated inside it.

    A step's gates and states are held lane by lane in each row, so that every gate is one span of memory.
    """
    h, (steps, width), room = layout.hidden, inputs.shape, room or Room()
    grads = [np.zeros_like(x) for x in par]
    x = np.take(par[0], inputs, axis=0, out=room("x", steps, width, layout.embedding), mode="clip")
    # What a gate's sigmoid, 1 / (1 + exp(-x)), takes has the other sign from the start.
    sign = np.repeat(np.array([-1, 1], F32), (2 * h, h))
    gates = np.matmul((par[1] * sign).T, x.transpose(0, 2, 1), out=room("gates", steps, 3 * h, width))
    gates += (par[3] * sign)[:, None]
    across = np.ascontiguousarray((par[2] * sign).T)
    hidden = room("hidden", steps, 3 * h, width)
    past, after, inner = room("past", steps, h, width), room("after", steps, h, width), room("inner", h, width)
    fresh = (~begins[:, None, :]).astype(F32)
    state = state.T
    for t in range(steps):
        np.multiply(state, fresh[t], out=past[t])
        np.matmul(across, past[t], out=hidden[t])
        zr, new = gates[t, : 2 * h], gates[t, 2 * h :]
        _shut(np.add(zr, hidden[t, : 2 * h], out=zr))
        new += np.multiply(zr[h:], hidden[t, 2 * h :], out=inner)
        np.tanh(new, out=new)
        state = np.subtract(past[t], new, out=after[t])
        state *= zr[:h]
        state += new
    seen = np.flatnonzero(live.ravel())
    everything = len(seen) == live.size
    flat = room("flat", steps * width, h)
    flat.reshape(steps, width, h)[:] = after.transpose(0, 2, 1)
    logs, back_seen = output_log(layout, par, flat if everything else flat[seen], targets.ravel()[seen], grads, room)
    back_flat = back_seen if everything else np.zeros_like(flat)
    if not everything:
        back_flat[seen] = back_seen
    back = room("back_steps", steps, h, width)
    back[:] = back_flat.reshape(steps, width, h).transpose(0, 2, 1)
    # What doesn't depend on the steps after: the gates' slopes.
    z, r, new = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
    dx, stay = room("dx", steps, 3 * h, width), np.subtract(F32(1), z, out=room("stay", steps, h, width))
    slope_z = np.subtract(past, new, out=dx[:, :h])
    slope_z *= z
    slope_z *= stay
    slope_n = np.multiply(new, new, out=dx[:, 2 * h :])
    np.subtract(F32(1), slope_n, out=slope_n)
    slope_n *= stay
    slope_r = np.subtract(F32(1), r, out=dx[:, h : 2 * h])
    slope_r *= r
    slope_r *= hidden[:, 2 * h :]
    dh = hidden  # its place is free from here on
    carry = np.zeros((h, width), F32)
    for t in range(steps - 1, -1, -1):
        d, own = back[t], dx[t]
        d += carry
        own[2 * h :] *= d
        own[:h] *= d
        own[h : 2 * h] *= own[2 * h :]
        dh[t, : 2 * h] = own[: 2 * h]
        np.multiply(own[2 * h :], r[t], out=dh[t, 2 * h :])
        np.matmul(par[2], dh[t], out=carry)
        d *= z[t]
        carry += d
        carry *= fresh[t]
    grads[1] += np.matmul(dx, x).sum(axis=0).T
    grads[3] += (dx @ np.ones(width, F32)).sum(axis=0)
    grads[2] += np.matmul(dh, past.transpose(0, 2, 1)).sum(axis=0).T
    order = np.argsort(inputs.ravel().astype(np.uint16) if layout.inputs <= 1 << 16 else inputs.ravel(), kind="stable")
    ranked = inputs.ravel()[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    to_inputs = np.matmul(dx.transpose(0, 2, 1), par[1].T, out=room("to_inputs", steps, width, layout.embedding))
    grads[0][ranked[first]] += np.add.reduceat(to_inputs.reshape(-1, layout.embedding)[order], first, axis=0)
    return -float(logs.sum()), len(seen), grads, state.T.copy()


def fit(layout: Layout, par: list[np.ndarray], texts: list[np.ndarray], start: int, *, window: int = 24, lanes_: int | None = None, rate: float = 0.01, epochs: int = 1) -> list[np.ndarray]:
    """Adam on truncated backpropagation through time; states are carried across windows.

    Texts follow one another in lanes, so all lanes stay full to the end of the longest.  A
    window in which few lanes are left takes a step as much smaller.
    """
    total = sum(map(len, texts))
    longest = max(map(len, texts), default=0)
    lanes_ = lanes_ or int(min(192, max(16, total // max(longest, 24 * window))))
    values = flatten(par)
    par = _views(layout, values)
    mean, var, steps = np.zeros_like(values), np.zeros_like(values), 0
    inputs, targets, begins, live = deal(texts, start, lanes_)
    room = Room()
    for _ in range(epochs):
        state = np.zeros((lanes_, layout.hidden), F32)
        for at in range(0, len(inputs), window):
            span = slice(at, at + window)
            width = lanes_ if live[at].all() else int(live[at].nonzero()[0].max(initial=-1)) + 1
            if live[at].sum() < width // 2:  # the lanes that still run come together
                keep = np.flatnonzero(live[at])
                inputs, targets, begins, live = (np.ascontiguousarray(v[:, keep]) for v in (inputs, targets, begins, live))
                state, width = state[keep], len(keep)
            now = [np.ascontiguousarray(v[span, :width]) for v in (inputs, targets, begins, live)]
            _, count, grads, last = window_grads(layout, par, state[:width], *now, room)
            state = last
            inputs, targets, begins, live = (v[:, :width] for v in (inputs, targets, begins, live))
            if not count:
                continue
            steps += 1
            scale = F32(rate * min(1.0, 2 * count / (lanes_ * window)) / (1 - 0.9**steps))
            g = flatten(grads)
            g *= F32(1 / count)
            np.clip(g, -0.1, 0.1, out=g)
            mean *= F32(0.9)
            mean += F32(0.1) * g
            g *= g
            g *= F32(0.01)
            var *= F32(0.99)
            var += g
            np.multiply(var, F32(1 / (1 - 0.99**steps)), out=g)
            np.sqrt(g, out=g)
            g += F32(1e-6)
            np.divide(mean, g, out=g)
            g *= scale
            values -= g
    return par
