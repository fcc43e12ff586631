"""Personal data by rules and by a character-level bidirectional LSTM with a CRF.

The rules find e-mail addresses, IPv4 addresses, card numbers and international
phone numbers; what they find stays. The model adds spans of all four kinds in other
writings: national phone numbers, spelt-out e-mail addresses, cards with dots or
wide gaps, addresses with bracketed or spaced dots. It is trained in numpy from
labelled spans (labelled_windows(): seeded, generated), with hard sigmoid and hard
tanh gates so that a step is a product and a few clips.

Whole texts are read in windows of WINDOW characters that overlap by 2 * MARGIN.
Where two windows overlap, their emissions are blended by the distance from either
edge; one Viterbi path per whole text is then the best one under the CRF. Only islands
of it need the search: a stretch of FAR characters that each lose as much by
any other tag as it takes to leave and enter again is "nothing" in some best path.
Windows without a digit or a sign of an address hold no valid span and are not read,
but for those beside one that has. A model span is widened to whole words, up to
SPARE outer ones are left out if it is not valid with them, and it is kept if it touches none of the rules' and its content is valid: four numbers up to 255, 14 to 19 digits with their check sum, 10 to 15 digits, or an address once
its signs are written out. The layout is the model's to judge.

Edge cases: null is an empty text, without spans. Equal texts get equal spans.
The input's other columns are kept; those named like an output column are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.store import bounded_batches, fields

KINDS = ("email", "ip", "card", "phone")
WINDOW, MARGIN, BATCH = 256, 16, 2048
HIDDEN = 10
FAR, JOIN, SPARE = 24, 12, 3
#: What a window must hold to be read, which every valid span does: a digit, an at sign, a bracketed "at", or "at" as a word before a host with a dot in any writing.
_TRIGGER = re.compile(r"[0-9@]|[(\[{<]\x20*at\x20*[)\]}>]|\x20at\x20++(?=[a-z0-9-]++(?:\.[a-z0-9-]|\x20*[(\[{<]\x20*(?:dot|\.)\x20*[)\]}>]|\x20+dot\x20))", re.I)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def rule_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind number, end, kept) of every match of the rules, by start and kind."""
    out = [(a, 0, b, True) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))) for m in _IP.finditer(text)]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) > 6:
                out.append((m.start(), 2, m.end(), 14 <= len(digits) <= 19 and luhn(digits)))
        out += [(m.start(), 3, m.end(), 10 <= len(_DIGIT.findall(m[0])) <= 15) for m in _PHONE.finditer(text)]
    return sorted(out)


# --- the model -------------------------------------------------------------

_PUNCT = ".@+-()_%:/,#[]<>="
_SPELT = "atdo"
_V = 6 + len(_PUNCT) + len(_SPELT)  # padding, lower, upper, digit, space, other; the letters of spelt-out signs apart
_CLASS = np.full(129, 5, np.int16)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[32, 9, 10, 11, 12, 13]] = 4
_CLASS[128] = 1
for _i, _c in enumerate(_PUNCT):
    _CLASS[ord(_c)] = 6 + _i
for _i, _c in enumerate(_SPELT):
    _CLASS[ord(_c)] = _CLASS[ord(_c.upper())] = 6 + len(_PUNCT) + _i
_TAGS = 1 + len(KINDS)


def char_classes(text: str) -> np.ndarray:
    return _CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def _by_direction(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums over time and windows of the products of (time, direction, window, …) arrays."""
    return np.stack([a[:, d].reshape(-1, a.shape[-1]).T @ b[:, d].reshape(-1, b.shape[-1]) for d in (0, 1)])


class Tagger:
    """x: gate inputs by class; u: recurrent; e, b: emissions; t: transitions. Direction 0 reads forward, 1 backward."""

    def __init__(self, seed: int = 5, hidden: int = HIDDEN):
        r = np.random.default_rng(seed)
        self.h = hidden
        self.p = {
            "x": r.normal(0, 0.5, (2, _V, 4 * hidden)),
            "u": r.normal(0, 0.4, (2, hidden, 4 * hidden)),
            "e": r.normal(0, 0.3, (2, hidden, _TAGS)),
            "b": np.array([1.0] + [0.0] * (_TAGS - 1)),
            "t": np.eye(_TAGS) * 1.0,
        }
        self.p["x"][:, :, hidden : 2 * hidden] += 1.0  # remember at first

    def emissions(self, classes: np.ndarray) -> np.ndarray:
        """(time, windows) classes to (time, tags, windows) scores, in float32; each gate is one block of rows."""
        steps, n, h = *classes.shape, self.h
        scale = np.r_[np.full(3 * h, 0.2), np.ones(h)].astype(np.float32)[:, None]
        shift = np.r_[np.full(3 * h, 0.5), np.zeros(h)].astype(np.float32)[:, None]
        out = np.empty((steps, _TAGS, n), np.float32)
        out[:] = self.p["b"].astype(np.float32)[None, :, None]
        z, zu = np.empty((4 * h, n), np.float32), np.empty((4 * h, n), np.float32)
        new, score = np.empty((h, n), np.float32), np.empty((_TAGS, n), np.float32)
        for d in (0, 1):
            x = np.ascontiguousarray(self.p["x"][d].T.astype(np.float32) * scale + shift)
            u = np.ascontiguousarray(self.p["u"][d].T.astype(np.float32) * scale)
            e = np.ascontiguousarray(self.p["e"][d].T.astype(np.float32))
            hid, cell = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
            for s in range(steps) if d == 0 else range(steps - 1, -1, -1):
                np.take(x, classes[s], axis=1, out=z, mode="clip")
                np.dot(u, hid, out=zu)
                z += zu
                np.clip(z[: 3 * h], 0.0, 1.0, out=z[: 3 * h])
                np.clip(z[3 * h :], -1.0, 1.0, out=z[3 * h :])
                np.multiply(z[:h], z[3 * h :], out=new)
                cell *= z[h : 2 * h]
                cell += new
                np.clip(cell, -1.0, 1.0, out=new)
                np.multiply(z[2 * h : 3 * h], new, out=hid)
                np.dot(e, hid, out=score)
                out[s] += score
        return out

    def paths(self, ems: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each text from its (time, tags) scores; a path begins and ends beside "nothing"."""
        move = self.p["t"].astype(np.float32)
        out = [np.zeros(len(e), np.int8) for e in ems]
        enter, leave, stay, idle = move[0, 1:], move[1:, 0], move[1:, 1:].max(), move[0, 0]
        split = max(0.0, float(2 * stay - enter.min() - leave.min())) + float(np.ptp(enter) + np.ptp(leave)) + 1e-2
        islands = []
        for i, e in enumerate(ems):
            loss = e[:, 0] + idle - e[:, 1:].max(axis=1) - stay
            hot = np.flatnonzero(loss < split / FAR)
            if len(hot):
                cuts = np.flatnonzero(np.diff(hot) > FAR)
                islands += [(int(b) + 1 - int(a), i, int(a)) for a, b in zip(hot[np.r_[0, cuts + 1]], hot[np.r_[cuts, len(hot) - 1]], strict=True)]
        islands.sort(reverse=True)
        at = 0
        while at < len(islands):
            end = at + max(1, min(4096, (1 << 20) // islands[at][0]))
            part = islands[at:end]
            em = np.full((part[0][0], _TAGS, len(part)), -1e4, np.float32)
            em[:, 0] = 0
            for j, (n, i, a) in enumerate(part):
                em[:n, :, j] = ems[i][a : a + n]
            for j, (n, i, a) in enumerate(part):
                if j == 0:
                    tags = self._search(em, move)
                out[i][a : a + n] = tags[:n, j]
            at = end
        return out

    def _search(self, em: np.ndarray, move: np.ndarray) -> np.ndarray:
        """Viterbi over (time, tags, islands), tag 0 before and after."""
        steps, _, n = em.shape
        back = np.zeros((steps, _TAGS, n), np.int8)
        best = em[0] + move[0][:, None]
        for s in range(1, steps):
            top = best[0] + move[0][:, None]
            for k in range(1, _TAGS):
                path = best[k] + move[k][:, None]
                back[s][path > top] = k
                top = np.maximum(top, path)
            best = top + em[s]
        tags = np.zeros((steps, n), np.int8)
        tag = (best + move[:, 0][:, None]).argmax(axis=0)
        tags[-1] = tag
        for s in range(steps - 1, 0, -1):
            tag = back[s][tag, np.arange(n)]
            tags[s - 1] = tag
        return tags

    # training: the same forward pass with what the gradient needs, both directions at once
    def _run(self, classes: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """Hidden states (time, direction, window, unit) in each direction's own time, and a tape."""
        h, (steps, n) = self.h, classes.shape
        kind = self.p["u"].dtype
        x = np.stack([self.p["x"][0][classes], self.p["x"][1][classes[::-1]]], axis=1)
        hid, cell, tape = np.zeros((2, n, h), kind), np.zeros((2, n, h), kind), []
        states = np.empty((steps, 2, n, h), kind)
        for s in range(steps):
            z = x[s] + hid @ self.p["u"]
            raw = z[..., : 3 * h] * 0.2 + 0.5
            gates, cand = np.clip(raw, 0, 1), np.clip(z[..., 3 * h :], -1, 1)
            cell_new = gates[..., h : 2 * h] * cell + gates[..., :h] * cand
            act = np.clip(cell_new, -1, 1)
            tape.append((hid, cell, gates, cand, act, gates == raw, z[..., 3 * h :] == cand, act == cell_new))
            hid, cell = gates[..., 2 * h :] * act, cell_new
            states[s] = hid
        return states, tape

    def _crf(self, em: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss per window and its gradients by emissions and transitions, by scaled sums of forward and backward products."""
        steps, n, k = em.shape
        move = np.exp(self.p["t"])
        high = em.max(axis=2, keepdims=True)
        local = np.exp(em - high)
        fwd, bwd, scale = np.empty_like(em), np.ones_like(em), np.empty((steps, n, 1), em.dtype)
        a = local[0]
        for s in range(steps):
            if s:
                a = (fwd[s - 1] @ move) * local[s]
            scale[s] = a.sum(axis=1, keepdims=True)
            fwd[s] = a / scale[s]
        for s in range(steps - 2, -1, -1):
            bwd[s] = ((local[s + 1] * bwd[s + 1]) @ move.T) / scale[s + 1]
        z = (np.log(scale) + high).sum(axis=(0, 2))
        rows, time = np.arange(n), np.arange(steps)[:, None]
        gold = em[time, rows, tags].sum(axis=0) + self.p["t"][tags[:-1], tags[1:]].sum(axis=0)
        g_em = fwd * bwd
        g_em[time, rows, tags] -= 1
        after = local[1:] * bwd[1:] / scale[1:]
        g_move = (fwd[:-1].reshape(-1, k).T @ after.reshape(-1, k)) * move
        np.add.at(g_move, (tags[:-1].ravel(), tags[1:].ravel()), -1)
        return float((z - gold).mean()), g_em / n, g_move / n

    def step(self, classes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of a batch of (time, windows)."""
        h, (steps, n) = self.h, classes.shape
        states, tape = self._run(classes)
        em = states[:, 0] @ self.p["e"][0] + states[::-1, 1] @ self.p["e"][1] + self.p["b"]
        loss, g_em, g_move = self._crf(em, tags)
        g = {"t": g_move, "b": g_em.sum(axis=(0, 1))}
        own = np.stack([g_em, g_em[::-1]], axis=1)  # in each direction's own time
        g["e"] = _by_direction(states, own)
        from_em = own @ self.p["e"].transpose(0, 2, 1)
        back = self.p["u"].transpose(0, 2, 1)
        g_hid, g_cell = np.zeros_like(states[0]), np.zeros_like(states[0])
        g_z = np.empty((steps, 2, n, 4 * h), states.dtype)
        for s in range(steps - 1, -1, -1):
            hid0, cell0, gates, cand, act, in_gate, in_cand, in_cell = tape[s]
            g_hid = g_hid + from_em[s]
            g_cell = g_cell + g_hid * gates[..., 2 * h :] * in_cell
            z = g_z[s]
            z[..., :h], z[..., h : 2 * h], z[..., 2 * h : 3 * h] = g_cell * cand, g_cell * cell0, g_hid * act
            z[..., : 3 * h] *= in_gate
            z[..., : 3 * h] *= 0.2
            z[..., 3 * h :] = g_cell * gates[..., :h] * in_cand
            g_hid, g_cell = z @ back, g_cell * gates[..., h : 2 * h]
        before = np.stack([t[0] for t in tape])
        g["u"] = _by_direction(before, g_z)
        g["x"] = np.stack([np.stack([np.bincount(c, z[:, k], _V) for k in range(4 * h)], axis=1) for c, z in ((classes.ravel(), g_z[:, 0].reshape(-1, 4 * h)), (classes[::-1].ravel(), g_z[:, 1].reshape(-1, 4 * h)))]).astype(states.dtype)
        return loss, g

    def train(self, classes: np.ndarray, tags: np.ndarray, epochs: int = 24, batch: int = 160, rate: float = 0.03, seed: int = 1) -> list[float]:
        """Adam over windows in columns; returns the mean loss of each epoch."""
        r = np.random.default_rng(seed)
        m, v, t, losses = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2)), 0, 0, []
        m, v = m
        for epoch in range(epochs):
            total = []
            for cols in np.array_split(r.permutation(classes.shape[1]), max(1, classes.shape[1] // batch)):
                loss, g = self.step(classes[:, cols], tags[:, cols])
                t += 1
                lr = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                total.append(loss)
            losses.append(float(np.mean(total)))
        return losses


def writings(r: np.random.Generator) -> dict[str, tuple[int, Callable[[], str]]]:
    """Ways to write personal data: name, kind number and a maker; those with _ in front are the rules' own."""

    def word(lo: int = 2, hi: int = 11) -> str:
        return "".join(r.choice(list("etaoinshrdlucmfwygpbvk"), r.integers(lo, hi)))

    def digits(k: int) -> str:
        return "".join(str(x) for x in r.integers(0, 10, k))

    def name() -> str:
        return str(r.choice([word(3), f"{word(3)}.{word(3)}", f"{word(3)}_{word(2)}", f"{word(3)}{digits(2)}"]))

    def card() -> str:
        body = digits(int(r.choice([13, 14, 15, 15, 15, 18])))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def groups(text: str, sep: str, size: int = 4) -> str:
        return sep.join(text[i : i + size] for i in range(0, len(text), size))

    def parts() -> list[str]:
        return [str(x) for x in r.integers(0, 256, 4)]

    tld = lambda: str(r.choice(["com", "org", "net", "de", "fr", "es", "info"]))
    return {
        "_email": (0, lambda: str(r.choice([f"{word()}.{digits(2)}@{word()}.{word()}.com", f"{word()}@{word()}.org", f"{word()}_{word()}@mail{digits(1)}.example.com"]))),
        "a [at] b [dot] com": (0, lambda: f"{name()} [at] {word()} [dot] {tld()}"),
        "a (at) b.com": (0, lambda: f"{name()}{r.choice([' ', ''])}({r.choice(['at', 'AT'])}){r.choice([' ', ''])}{word()}.{tld()}"),
        "a at b dot com": (0, lambda: f"{name()} at {word(3)} dot {tld()}"),
        "a at b.com": (0, lambda: f"{name()} at {str(r.choice(['', word(3) + '.']))}{word(3)}.{tld()}"),
        "_ip": (1, lambda: ".".join(parts())),
        "1[.]2[.]3[.]4": (1, lambda: str(r.choice(["[.]", "(.)"])).join(parts())),
        "1 . 2 . 3 . 4": (1, lambda: " . ".join(parts())),
        "_card": (2, lambda: groups(card(), str(r.choice(["", "", " ", "-"])))),
        "dddd.dddd.dddd.dddd": (2, lambda: groups(card(), ".")),
        "dddd  dddd  dddd  dddd": (2, lambda: groups(card(), str(r.choice(["  ", " - ", "/"])))),
        "_phone": (3, lambda: str(r.choice([f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(6)}", f"+{digits(11)}"]))),
        "(ddd) ddd-dddd": (3, lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"),
        "ddd-ddd-dddd": (3, lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"),
        "ddd ddd dddd": (3, lambda: f"{digits(3)} {digits(3)} {digits(4)}"),
        "ddd.ddd.dddd": (3, lambda: f"{digits(3)}.{digits(3)}.{digits(4)}"),
        "(dddd) dddddd": (3, lambda: f"({digits(4)}) {digits(6)}"),
        "0d dd dd dd dd": (3, lambda: f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}"),
        "0ddd/ddddddd": (3, lambda: f"0{digits(int(r.integers(2, 5)))}{r.choice(['/', ' ', '-'])}{digits(int(r.integers(7, 9)))}"),
    }


def labelled_windows(n: int = 1600, width: int = 72, seed: int = 3) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated texts with their (start, end, kind number) spans."""
    r = np.random.default_rng(seed)
    made = list(writings(r).values())

    def word(lo: int = 2, hi: int = 11) -> str:
        return "".join(r.choice(list("etaoinshrdlucmfwygpbvk"), r.integers(lo, hi)))

    def digits(k: int) -> str:
        return "".join(str(x) for x in r.integers(0, 10, k))

    plain = (
        lambda: word(), lambda: word(), lambda: word(), lambda: word().title(), lambda: word() + ".", lambda: word() + ",", lambda: word().upper() + "!!", lambda: word() + str(r.choice(["###", "%%%", "***", "$$$", "&&&"])),
        lambda: digits(int(r.integers(1, 6))), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"${digits(3)}.{digits(2)}", lambda: "|",
        lambda: 'token = "' + "".join(r.choice(list("0123456789abcdef"), 30)) + '"', lambda: f"https://{word()}.{word()}.com/{word()}?{word()}={digits(3)}", lambda: f"({word()})", lambda: f"@{word()}", lambda: f"+{digits(2)}%", lambda: "at", lambda: "dot", lambda: digits(int(r.integers(6, 10))), lambda: f"AKIA{word().upper()}{digits(6)}",
        lambda: f"{word()} at {word()}", lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: f"{digits(3)},{digits(3)},{digits(3)}.{digits(2)}", lambda: f"{digits(2)} {digits(2)} {digits(2)}", lambda: f"{digits(3)}-{digits(2)}", lambda: f"({digits(4)})", lambda: f"{digits(1)}.{digits(2)} {digits(1)}.{digits(2)} {digits(1)}.{digits(2)} {digits(1)}.{digits(2)}", lambda: f"{digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", lambda: digits(int(r.integers(10, 14))),
    )
    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < width:
            if r.random() < 0.2:
                kind, make = made[r.integers(len(made))]
                shown = make()
                spans.append((len(text), len(text) + len(shown), kind))
            else:
                shown = plain[r.integers(len(plain)) if r.random() < 0.4 else r.integers(8)]()
            text += shown + str(r.choice(["\n", ", ", ". ", " ", " ", " ", " ", " ", " ", " "]))
        out.append((text, spans))
    return out


def _columns(labelled: list[tuple[str, list[tuple[int, int, int]]]], width: int) -> tuple[np.ndarray, np.ndarray]:
    classes, tags = np.zeros((width, len(labelled)), np.int64), np.zeros((width, len(labelled)), np.int64)
    for j, (text, spans) in enumerate(labelled):
        c = char_classes(text)[:width]
        classes[: len(c), j] = c
        for a, b, kind in spans:
            tags[a : min(b, width), j] = kind + 1
    return classes, tags


@lru_cache(maxsize=4)
def trained(n: int = 1600, width: int = 72, seed: int = 3) -> Tagger:
    """The tagger learnt from labelled_windows(n, width, seed): the same at each call."""
    tagger = Tagger()
    tagger.p = {k: v.astype(np.float32) for k, v in tagger.p.items()}
    tagger.train(*_columns(labelled_windows(n, width, seed), width))
    return tagger


# --- whole texts -----------------------------------------------------------


def _wanted(text: str) -> list[int]:
    """Starts of the windows to read: those that hold a trigger, and their neighbours."""
    hop = WINDOW - 2 * MARGIN
    count = max(1, -(-(len(text) - 2 * MARGIN) // hop))
    hit = np.zeros(count + 2, bool)
    for m in _TRIGGER.finditer(text):
        last = min(m.start() // hop, count - 1)
        hit[last : last + 3] = True  # its own window, the one before (in whose overlap it may lie) and the one behind
    return [hop * int(k) for k in np.flatnonzero(hit[1:-1])]


def tag_texts(tagger: Tagger, texts: list[str]) -> list[np.ndarray]:
    """The tag of each character of each text: blended emissions of overlapping windows, one best path for the whole text."""
    hop, lap = WINDOW - 2 * MARGIN, 2 * MARGIN
    where = [(i, s) for i, t in enumerate(texts) if t for s in _wanted(t)]
    out = [np.zeros(len(t), np.int8) for t in texts]
    if not where:
        return out
    ems = {i: np.full((len(texts[i]), _TAGS), -1e3, np.float32) for i, _ in where}
    for e in ems.values():
        e[:, 0] = 0
    codes = {i: char_classes(texts[i]) for i in ems}
    rise = ((np.arange(lap) + 0.5) / lap).astype(np.float32)[:, None]
    last: tuple[int, int, np.ndarray | None] = (-1, -1, None)
    for lo in range(0, len(where), BATCH):
        part = where[lo : lo + BATCH]
        grid = np.zeros((len(part), WINDOW), np.intp)
        for j, (i, s) in enumerate(part):
            c = codes[i][s : s + WINDOW]
            grid[j, : len(c)] = c
        found = np.ascontiguousarray(tagger.emissions(np.ascontiguousarray(grid.T)).transpose(2, 0, 1))
        for j, (i, s) in enumerate(part):
            e, own = ems[i], found[j][: len(texts[i]) - s]
            tail = last[2] if last[:2] == (i, s - hop) else None
            e[s : s + WINDOW] = own
            if tail is not None:
                n = min(lap, len(own))
                e[s : s + n] = rise[:n] * own[:n] + (1 - rise[:n]) * tail[:n]
            last = (i, s, found[j][hop:])
    for i, path in zip(ems, tagger.paths(list(ems.values())), strict=True):
        out[i] = path
    return out


_AT = re.compile(r"\x20*[(\[{<]\x20*at\x20*[)\]}>]\x20*|\x20+at\x20+", re.I)
_DOT = re.compile(r"\x20*[(\[{<]\x20*(?:dot|\.)\x20*[)\]}>]\x20*|\x20+dot\x20+", re.I)
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER = re.compile("[0-9]+")
_WORD = re.compile(r"\S+")


# Words that stand before "at" and the name of a site, and before numbers with dots that are no addresses.
_BEFORE_AT = frozenset("is are was were be been it us you him her them or and but not now here there online available found find see look read more only hosted live page site shop visit sold shown listed posted published meet start starts stay arrive".split())
_VERSION = re.compile(r"(?:version|release|section|chapter|build|clause|ver|v)[\x20.:#-]*$", re.I)


def _valid(shown: str, kind: int, before: str = "") -> bool:
    """Whether what is written, in whatever layout, can be of its kind; before is the text in front of it.

    A spelt-out "at" behind a word of prose makes no address, pairs of digits no
    phone number unless they begin with 0, and a version no IP address.
    """
    if kind == 0:
        plain = re.split(r"\x20+at\x20+", shown, maxsplit=1, flags=re.I)
        if len(plain) == 2 and plain[0].lower() in _BEFORE_AT:
            return False
        return bool(_ADDRESS.fullmatch(_DOT.sub(".", _AT.sub("@", shown))))
    if kind == 1 and _VERSION.search(before):
        return False
    numbers = _NUMBER.findall(shown)
    if kind == 1:
        return len(numbers) == 4 and all(int(x) <= 255 for x in (y[-9:] for y in numbers)) and all(len(x.lstrip("0")) <= 3 for x in numbers) and not any(c.isalpha() for c in shown)
    digits = "".join(numbers)
    if any(c.isalpha() for c in shown):
        return False
    if kind == 3 and len(numbers) > 1 and all(len(x) <= 2 for x in numbers) and digits[0] != "0" and "+" not in shown:
        return False
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 10 <= len(digits) <= 15


def _within(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """A span, then the spans without one to SPARE of its outer words, the fewest left out first."""
    words = [(a + m.start(), a + m.end()) for m in _WORD.finditer(text[a:b])] if b - a <= 4 * WINDOW else [(a, b)]
    for total in range(min(SPARE + 1, len(words))):
        for left in range(total + 1):
            x, y = words[left][0], words[len(words) - 1 - total + left][1]
            while y > x and text[y - 1] in ".,;:!?":
                y -= 1
            yield x, y


def model_spans(tags: np.ndarray, text: str, taken: list[tuple[int, int, int, bool]]) -> list[tuple[int, int, int]]:
    """Runs of one tag, trimmed of space, that touch none of taken and are valid."""
    if not tags.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate(([0], tags, [0]))))
    kept = [x for x in taken if x[3]]
    starts, ends = [x[0] for x in kept], list(accumulate((x[2] for x in kept), max))
    out, last = [], 0
    runs = [(a, b, int(tags[a]) - 1) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if tags[a]]
    joined: list[tuple[int, int, int]] = []
    for a, b, kind in runs:  # what the path parts by less than a word is one span
        if joined and joined[-1][2] == kind and a - joined[-1][1] <= JOIN:
            joined[-1] = (joined[-1][0], b, kind)
        else:
            joined.append((a, b, kind))
    tried = sorted({*joined, *runs}, key=lambda x: (x[0], -x[1]))
    for a, b, kind in tried:
        while a < b and text[a].isspace():
            a += 1
        while b > a and (text[b - 1].isspace() or text[b - 1] in ".,;:"):
            b -= 1
        if a >= b or a < last:
            continue
        # an end within a word or number goes to its end
        least, most = max(last, a - WINDOW), min(len(text), b + WINDOW)
        while a > least and (text[a - 1].isalnum() or kind == 0 and text[a - 1] in "._%+-"):
            a -= 1
        while b < most and text[b].isalnum():
            b += 1
        for x, y in _within(text, a, b):
            upto = bisect_left(starts, y)
            alone = not upto or ends[upto - 1] <= x
            bounded = (x == 0 or not (text[x - 1].isalnum() or text[x - 1] in "+-.")) and (y == len(text) or not text[y].isalnum())
            if alone and bounded and _valid(text[x:y], kind, text[max(0, x - 16) : x]):
                out.append((x, kind, y))
                last = y
                break
    return out


def _spans(tagger: Tagger, texts: list[str | None]) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text the rules' spans and all spans, as (start, kind number, end)."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= 1 << 20):
            size += len(texts[end] or "")
            end += 1
        part = [t or "" for t in texts[at:end]]
        for text, tags in zip(part, tag_texts(tagger, part), strict=True):
            found = rule_matches(text)
            kept = [x[:3] for x in found if x[3]]
            yield kept, sorted(kept + model_spans(tags, text, found))
        at = end


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span, or run of spans that overlap, replaced by the kind of its first in angle brackets."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """docs with all spans in text masked; n_chars, if there is one, follows. Null stays null."""
    tagger = tagger or trained()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["text"].to_pylist()
            clean = pa.array([t if t is None or not spans else masked(t, spans) for t, (_, spans) in zip(texts, _spans(tagger, texts), strict=True)], pa.string())
            yield b.set_column(b.schema.get_field_index("text"), "text", clean)

    found = bounded_batches(docs).mapInArrow(scan, docs.schema)
    if "n_chars" not in docs.columns:
        return found
    kind = docs.schema["n_chars"].dataType
    return found.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))


def find_personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """docs with base_spans and spans, arrays of (start, kind, end, name) by start and kind, code points, end exclusive; spans holds both the rules' and the model's."""
    tagger = tagger or trained()
    docs = bounded_batches(docs).drop("base_spans", "spans")
    span = "array<struct<start:int,no:int,end:int,kind:string>>"
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("no", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def shown(rows: list[tuple[int, int, int]]) -> list[dict]:
        return [{"start": a, "no": k, "end": b, "kind": KINDS[k]} for a, k, b in rows]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(_spans(tagger, b["text"].to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([shown(x) for x, _ in found], kinds), pa.array([shown(y) for _, y in found], kinds)], names=[*b.schema.names, "base_spans", "spans"])

    return docs.mapInArrow(scan, fields(docs, f"base_spans {span}, spans {span}"))
