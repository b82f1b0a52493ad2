"""Signatures of shingle sets: exponential arrivals with early termination, for many texts at once."""

from __future__ import annotations

from math import comb

import numpy as np

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection that scatters close inputs."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, 44-bit hash and count of each distinct run of ``width`` characters; at most 2**20 texts.

    A text shorter than ``width`` has no run.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * _U(0x9E3779B97F4A7C15) + codes[k : k + n]
    owner = np.repeat(np.arange(len(texts)), lengths)
    inside = owner[:n] == owner[width - 1 :]
    key = (owner[:n][inside].astype(np.uint64) << _U(44)) | (mix(h[inside]) >> _U(20))
    key, count = np.unique(key, return_counts=True)
    return (key >> _U(44)).astype(np.int64), key & _U((1 << 44) - 1), count


def probminhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray | None, texts: int, registers: int) -> np.ndarray:
    """``texts x registers`` identities of winning elements; two rows agree in a register with the probability Jaccard
    similarity of their weighted sets (the plain one if ``weight`` is None).

    Each element brings a Poisson process whose rate is its weight, seeded by the element alone, and each arrival goes
    to a random register; a register keeps its earliest arrival. All elements advance by one arrival per round, and an
    element retires once its clock passes the latest register of its text, as no later arrival can win. A text without
    elements gets 0 everywhere.
    """
    first = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    clock = np.zeros(len(owner))
    rate = None if weight is None else weight.astype(float)
    round_no = 0
    while len(owner):
        round_no += 1
        r = mix(element + np.full(1, round_no, np.uint64) * _U(0x9E3779B97F4A7C15))
        step = -np.log(((r >> _U(24)).astype(float) + 1.0) / float(1 << 40))
        clock = clock + (step if rate is None else step / rate)
        slot = owner * registers + ((r & _U(0xFFFFFF)) % _U(registers)).astype(np.int64)
        near = clock < first[slot]
        at, when = slot[near], clock[near]
        np.minimum.at(first, at, when)
        won = first[at] == when
        winner[at[won]] = element[near][won]
        alive = clock < first.reshape(texts, registers).max(axis=1)[owner]
        owner, element, clock = owner[alive], element[alive], clock[alive]
        rate = None if rate is None else rate[alive]
    return winner.reshape(texts, registers)


def fold(winners: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each group of ``rows`` neighbouring registers, different for equal groups in other places."""
    texts, registers = winners.shape
    groups = winners.reshape(texts, registers // rows, rows)
    out = np.broadcast_to(np.arange(1, registers // rows + 1, dtype=np.uint64), groups.shape[:2]).copy()
    for k in range(rows):
        out = mix(out * _U(0x9E3779B97F4A7C15) + groups[:, :, k])
    return out


def agreeing(bits: int, least: float, miss: float = 1e-4) -> int:
    """How many of ``bits`` one-bit registers two texts must share. Texts of the similarity ``least`` share each with the
    probability (1 + least) / 2 and fall below this number with the probability ``miss`` at most; more alike ones less."""
    p, below = (1 + least) / 2, 0.0
    for n in range(bits + 1):
        below += comb(bits, n) * p**n * (1 - p) ** (bits - n)
        if below > miss:
            return n
    return bits


def meetings(batches, least: float, most: int = 200_000):
    """Arrays ``a, b`` of the pairs of rows ``g, rep, runs, side, bits``, sorted by ``g, rep``, with equal ``g``: those of
    opposite sides, or both of side 0, whose runs and bits allow the similarity ``least``. Arrow batches of one partition
    come in; rows of the last group are held until it is complete."""
    out_a, out_b, held, waiting = [], [], [], 0

    def columns(parts):
        g, rep, size, side = (np.concatenate([b.column(k).to_numpy() for b in parts]) for k in range(4))
        joined = b"".join(x for b in parts for x in b.column(4).to_pylist())
        return g, rep, size.astype(float), side, np.frombuffer(joined, np.uint8).reshape(len(g), -1)

    def pairs(g, rep, size, side, bits):
        width = bits.shape[1]
        words = np.zeros((len(g), -(-width // 8) * 8), np.uint8)
        words[:, :width] = bits
        words = [np.ascontiguousarray(w) for w in words.view(np.uint64).T]
        apart = width * 8 - agreeing(width * 8, least)
        i, step = np.flatnonzero(g[1:] == g[:-1]), 1
        while len(i):
            j = i + step
            x, y, s, t = size[i], size[j], side[i], side[j]
            ok = np.flatnonzero((y >= x * least) & (y * least <= x) & ((s == 0) & (t == 0) | (s * t < 0)) & (rep[i] < rep[j]))
            m, n = i[ok], j[ok]
            differ = sum(np.bitwise_count(w[m] ^ w[n]).astype(np.int32) for w in words)
            yield rep[m[differ <= apart]], rep[n[differ <= apart]]
            step += 1
            i = i[i + step < len(g)]
            i = i[g[i + step] == g[i]]

    def done(parts):
        nonlocal out_a, out_b, waiting
        for a, b in pairs(*columns(parts)):
            out_a.append(a)
            out_b.append(b)
            waiting += len(a)
            if waiting > most:
                yield np.concatenate(out_a), np.concatenate(out_b)
                out_a, out_b, waiting = [], [], 0

    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(0).to_numpy()
        start = int(np.searchsorted(g, g[-1]))
        if start or held and held[-1].column(0)[0].as_py() != g[0]:
            yield from done([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
    if held:
        yield from done(held)
    if out_a:
        yield np.concatenate(out_a), np.concatenate(out_b)


def runs(text: str, width: int) -> set[str]:
    return {text[i : i + width] for i in range(len(text) - width + 1)}


def jaccard(pairs, width: int) -> list[float]:
    """Exact similarity of pairs of texts; equal neighbours on the first side are cut once. Two texts without runs have 0."""
    out, last, left = [], None, set()
    for a, b in pairs:
        if a != last:
            last, left = a, runs(a, width)
        right = runs(b, width)
        both = len(left & right)
        out.append(both / (len(left) + len(right) - both) if both else 0.0)
    return out
