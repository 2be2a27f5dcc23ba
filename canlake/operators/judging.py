"""What differs between two logs' histograms of one ID: numpy over at most 64 bytes x 256 values, never over frames."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Thresholds and weights of the comparison.
SIGNIFICANT, MIN_FRAMES, MEASURED, HOLE_STEPS, READING, STRETCHES = 0.1, 8, 8, 4, 4, 64
RATE_TOLERANCE, RATE_WEIGHT, FORMAT_SCORE, QUALITATIVE, GRADED_MAX, SMALL = 1.1, 0.8, 0.9, 0.75, 0.5, 0.35
# Texts of what is found.
TOO_FEW, NONE, WITHIN = "Too few frames to compare", "No significant changes", "Also changes within A"
NEW, ONLY_A, DIFFERENT, MORE, LESS, SHIFT = "takes new values", "has values only in A", "holds a different value", "changes more often", "changes less often", "values shift"
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1  # value x bit


class Profile:
    """One ID's histograms in one stretch of a log, by byte: values, their stretches, and of pairs the XORs and steps."""

    def __init__(self, size: int, span_s: float) -> None:
        self.span_s, self.frames, self.payloads, self.fd, self.full = span_s, 0, 0, 0, 0
        self.values, self.xors, self.steps = (np.zeros((size, 256), np.int64) for _ in range(3))
        self.high, self.stretches, self.last = np.zeros((size, 16), np.int64), np.zeros((size, 256), np.uint64), np.full(size, -1)
        self.first_sum, self.last_sum, self.xor_all = (np.zeros(256, np.int64) for _ in range(3))
        self.lengths: set[int] = set()

    @property
    def longest(self) -> int:
        return max(self.lengths, default=0)

    def take(self, hist: np.ndarray, byte: np.ndarray, x: np.ndarray, n: np.ndarray, mask: np.ndarray) -> None:
        """Fills in cells (histogram, byte, x, count, stretches)."""
        of = lambda name: hist == name
        for name, table in (("value", self.values), ("xor", self.xors), ("step", self.steps), ("high", self.high)):
            table[byte[of(name)], x[of(name)]] = n[of(name)]
        self.stretches[byte[of("value")], x[of("value")]] = mask[of("value")].astype(np.int64).view(np.uint64)
        self.last[byte[of("last")]] = x[of("last")]
        for name, table in (("first sum", self.first_sum), ("last sum", self.last_sum), ("all xor", self.xor_all)):
            table[x[of(name)]] = n[of(name)]
        self.frames, self.fd = int(n[of("frames")].sum()), int(n[of("fd")].sum())
        self.lengths, self.payloads = set(x[of("length")].tolist()), int(n[of("length")].sum())
        self.full = int(self.xor_all.sum())


def distinct(values: np.ndarray, mask: int = 0xFF) -> int:
    return len(np.unique(np.flatnonzero(values) & mask))


def masked(values: np.ndarray, keep: int) -> np.ndarray:
    """Counts by the kept bits of a value."""
    return np.bincount(np.arange(256) & keep, weights=values, minlength=256).astype(np.int64)


def masked_stretches(stretches: np.ndarray, keep: int) -> np.ndarray:
    out = np.zeros(256, np.uint64)
    np.bitwise_or.at(out, np.arange(256) & keep, stretches)
    return out


def counters_and_checksums(p: Profile) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each byte that behave like a counter, and like a checksum."""
    size = len(p.values)
    counter, checksum = np.zeros(size, np.int64), np.zeros(size, np.int64)

    def one_step(steps: np.ndarray, pairs: int) -> bool:
        return pairs >= 8 and steps[1:].max(initial=0) >= 0.8 * pairs

    for k in range(size):
        steps, pairs = p.steps[k], int(p.xors[k].sum())
        best = 255 - int(np.argmax(steps[:0:-1]))  # of equal counts the largest step
        uncarried = steps[(best - 16) % 256] + steps[(best + 16) % 256]
        if one_step(steps, pairs) and distinct(p.values[k]) > 16 and uncarried * 20 < pairs:
            counter[k] = 0xFF
            continue
        low = steps.reshape(16, 16).sum(axis=0)
        counter[k] |= 0x0F if one_step(low, pairs) and distinct(p.values[k], 0x0F) >= 4 else 0
        counter[k] |= 0xF0 if one_step(p.high[k], pairs) and distinct(p.values[k], 0xF0) >= 4 else 0
    if size < 2:
        return counter, checksum
    kinds = np.array([distinct(v) for v in p.values])
    candidate = lambda k: kinds[k] >= 4 and (np.delete(kinds, k) >= 2).sum() >= 2
    constant = lambda hist: p.full >= 8 and hist.max() >= 0.95 * p.full
    if constant(p.last_sum) and candidate(size - 1):
        checksum[size - 1] = 0xFF
    elif constant(p.first_sum) and candidate(0):
        checksum[0] = 0xFF
    if constant(p.xor_all) and not checksum.any():
        for k in (size - 1, 0):
            if candidate(k):
                checksum[k] = 0xFF
                break
    for k in (0, size - 1):
        pairs = int(p.xors[k].sum())
        if pairs >= 32 and pairs - p.xors[k][0] >= 0.9 * pairs and kinds[k] >= 16:
            share = p.xors[k] @ _BITS / pairs
            if ((share >= 0.25) & (share <= 0.75)).all():
                checksum[k] = 0xFF
    return counter, checksum


def spreads(values: np.ndarray, hole: int) -> tuple[list[np.ndarray], bool]:
    """The values grouped where gaps are wider than a hole, and whether they go on from 255 to 0; then the last spread holds the first."""
    if not len(values):
        return [], False
    parts = np.split(values, np.flatnonzero(np.diff(values) > hole) + 1)
    wraps = len(values) > 1 and values[0] + 256 - values[-1] <= hole
    if wraps and len(parts) > 1:
        parts = [*parts[1:-1], np.concatenate((parts[-1], parts[0] + 256))]
    return parts, bool(wraps)


def reach(reference: np.ndarray, other: np.ndarray, unit: int) -> np.ndarray:
    """Values that a measurement's values explain: in its small holes, a step past its ends, or thinning out as its ends do."""
    explained = np.zeros(256, bool)
    values = np.flatnonzero(reference)
    if len(values) < MEASURED:
        return explained
    sparse, hole = reference < reference[values].mean(), HOLE_STEPS * unit
    parts, wraps = spreads(values, hole)
    place = lambda p: p % 256 if wraps else p if 0 <= p < 256 else None
    for part in parts:
        explained[np.arange(part[0], part[-1] + 1) % 256] = True
        thin = sparse[part % 256]
        for end, way, order in ((int(part[0]), -1, thin), (int(part[-1]), 1, thin[::-1])):
            thinning = len(order) if order.all() else int(np.argmin(order))
            if (at := place(end + way * unit)) is not None:
                explained[at] = True
            last, trail = end, []
            for p in range(end + way, end + 257 * way, way):
                at = place(p)
                if abs(p - last) > hole or at is None or reference[at]:
                    break
                if other[at]:
                    trail.append(at)
                    last = p
            if abs(last - end) <= thinning * unit:
                explained[trail] = True
    return explained


def novelty(reference: np.ndarray, other: np.ndarray, stretches: np.ndarray, unit: int, ratio: float, skip: np.ndarray) -> tuple[float, np.ndarray]:
    """How surely the other log's values are new, and which they are; ratio: how many times as long the reference ran."""
    new = np.flatnonzero((other > 0) & (reference == 0) & ~skip & ~reach(reference, other, unit))
    if not len(new):
        return 0.0, new
    share = other[new].sum() / other.sum()
    # separate times that a value comes up: runs of neighbouring stretches
    times = max(int(m & ~((m << 1) & (2**64 - 1))).bit_count() for m in map(int, stretches[new]))
    reading = (other > 0).sum() >= READING
    more, covered = (max(ratio, 1.0), min(ratio, 1.0)) if reading else (ratio, 1.0)
    expected = min((times + 1) * more, share * reference.sum())
    return float((1 - np.exp(-expected)) * covered * (QUALITATIVE + (1 - QUALITATIVE) * min(4 * share, 1.0))), new


def telling(reference: np.ndarray, new: np.ndarray, keep: int) -> int:
    """Bits that tell new values apart: steady ones that they flip, or else those in which they differ from the commonest value."""
    seen = np.flatnonzero(reference)
    ones, zeros = int(np.bitwise_or.reduce(seen)), int(np.bitwise_or.reduce(~seen & 0xFF))
    steady = ~(ones & zeros) & keep & 0xFF
    flipped = int(np.bitwise_or.reduce((new & steady) ^ (ones & steady)))
    common = 255 - int(np.argmax(reference[::-1]))
    return flipped or int(np.bitwise_or.reduce((new ^ common) & keep))


@dataclass
class ByteDiff:
    """Scores and words of a byte: graded change, new values, values only in A; and what these values and the bits' scores are."""

    parts: list[tuple[float, str]]
    bits: np.ndarray
    new: np.ndarray
    only_a: np.ndarray

    def best(self, noise: ByteDiff | None = None) -> tuple[float, str]:
        base = max(s for s, _ in noise.parts) if noise else 0.0
        scores = [max(s - base, 0.0) if i == 0 else s for i, (s, _) in enumerate(self.parts)]
        top = int(np.argmax(scores))
        return (scores[top], self.parts[top][1]) if scores[top] > 0 else (0.0, SHIFT)


def drifted(a: np.ndarray, b: np.ndarray, first_half: np.ndarray, end: int, keep: int, hole: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of A, and of B, that a drifting A explains: it ends near an end of its spread on a value that only its second half shows."""
    in_a, in_b = np.zeros(256, bool), np.zeros(256, bool)
    end &= keep
    if end < 0 or first_half[end]:
        return in_a, in_b
    parts, wraps = spreads(np.flatnonzero(a), hole)
    part = next((p for p in parts if (p % 256 == end).any()), None)
    if part is None:
        return in_a, in_b
    at = int(part[np.argmax(part % 256 == end)])
    if part[-1] - at <= hole:
        edge, way = int(part[-1]), 1
    elif at - part[0] <= hole:
        edge, way = int(part[0]), -1
    else:
        return in_a, in_b
    last = None
    for p in range(edge + way, edge + 256 * way, way):
        v = p % 256 if wraps else p
        if not 0 <= v < 256 or a[v]:
            break
        if b[v]:
            if last is not None and abs(p - last) > hole:
                break
            in_b[v], last = True, p
    return a > 0, in_b


def byte_diff(a: Profile, b: Profile, k: int, keep: int, halves: tuple[Profile, Profile] | None) -> ByteDiff | None:
    va, vb = masked(a.values[k], keep), masked(b.values[k], keep)
    if not keep or not va.any() or not vb.any():
        return None
    short, long = sorted((a.span_s, b.span_s))
    graded = GRADED_MAX * (np.sqrt(short / long) if short > 0 else 1.0)
    kept = (keep >> np.arange(8)) & 1
    set_ = graded * np.abs(va @ _BITS / va.sum() - vb @ _BITS / vb.sum()) * kept
    toggles = [p.xors[k] @ _BITS / max(p.xors[k].sum(), 1) for p in (a, b)]
    toggle = graded * np.abs(toggles[0] - toggles[1]) * kept
    bits, best = np.maximum(set_, toggle), (0.0, SHIFT)
    for bit in range(8):
        for score, word in ((set_[bit], SHIFT), (toggle[bit], MORE if toggles[1][bit] > toggles[0][bit] else LESS)):
            best = (float(score), word) if score > best[0] else best
    unit = keep & -keep
    none = np.zeros(256, bool)
    skip_a, skip_b = none, none
    if halves:
        one, two = (masked(h.values[k], keep) for h in halves)
        left, skip_b = drifted(va, vb, one, int(a.last[k]), keep, HOLE_STEPS * unit)
        # values that A keeps varying over, while its halves differ
        skip_a = left | ((one > 0) & (two > 0) & bool(((one > 0) != (two > 0)).any()))
    ratio = a.span_s / b.span_s if a.span_s > 0 and b.span_s > 0 else 1.0
    new_b, values_b = novelty(va, vb, masked_stretches(b.stretches[k], keep), unit, ratio, skip_b)
    new_a, values_a = novelty(vb, va, masked_stretches(a.stretches[k], keep), unit, 1 / ratio, skip_a)
    for score, reference, values in ((new_b, va, values_b), (new_a, vb, values_a)):
        if score > 0:
            bits = np.where((telling(reference, values, keep) >> np.arange(8)) & 1, np.maximum(bits, score), bits)
    word = DIFFERENT if distinct(va) == 1 and distinct(vb) == 1 else NEW
    return ByteDiff([best, (new_b, word), (new_a, ONLY_A)], bits, values_b, values_a)


def rate_score(ratio: float, frames: int) -> float:
    """0 within the tolerance, which is wider for few frames, RATE_WEIGHT from twice the rate on, and in proportion between."""
    up = 1 / ratio if ratio < 1 else ratio
    tolerance = RATE_TOLERANCE + 2.0 / max(frames, 1)
    return 0.0 if tolerance >= 2 else RATE_WEIGHT * min(max((up - tolerance) / (2 - tolerance), 0.0), 1.0)


class Components:
    """Everything that differs between two profiles of an ID."""

    def __init__(self, a: Profile, b: Profile, keep: np.ndarray, halves: tuple[Profile, Profile] | None = None) -> None:
        self.ratio = (b.frames / b.span_s) / (a.frames / a.span_s) if a.span_s > 0 and b.span_s > 0 and a.frames else None
        self.rate = rate_score(self.ratio, min(a.frames, b.frames)) if self.ratio else 0.0
        self.length = FORMAT_SCORE if a.longest != b.longest else 0.0
        self.fd = FORMAT_SCORE if (a.fd == 0) != (b.fd == 0) else 0.0
        self.bytes = [byte_diff(a, b, k, int(keep[k]), halves) for k in range(len(keep))]


def percent(score: float) -> int:
    return int(np.floor(min(max(score, 0.0), 1.0) * 100 + 0.5))


def significant(score: float) -> bool:
    return percent(score) >= percent(SIGNIFICANT)


def byte_text(k: int, word: str, score: float) -> str:
    return "Small value changes" if score < SMALL and word in (MORE, LESS, SHIFT) else f"Byte {k} {word}"


def _rate_text(ratio: float) -> str:
    if 1.8 <= ratio <= 2.2:
        return "Rate doubled"
    if 0.45 <= ratio <= 0.55:
        return "Rate halved"
    return f"Rate up {ratio:.1f}x" if ratio > 1 else f"Rate down {1 / ratio:.1f}x"


def judge(a: Profile, b: Profile, halves: tuple[Profile, Profile] | None, ignore_counters: bool) -> dict:
    """Score, reason and bytes of an ID that both logs have. halves: A's own, for what changes within A alone."""
    size = len(a.values)
    counter = checksum = np.zeros(size, np.int64)
    if ignore_counters:
        (ca, sa), (cb, sb) = counters_and_checksums(a), counters_and_checksums(b)
        counter = ca & cb
        checksum = sa & sb & ~counter
    keep = ~(counter | checksum) & 0xFF
    if halves and min(h.frames for h in halves) < MIN_FRAMES:
        halves = None
    found = Components(a, b, keep, halves)
    plain = Components(a, b, keep) if halves else None
    noise = Components(*halves, keep) if halves else None
    few = min(a.frames, b.frames) < MIN_FRAMES
    differ = a.lengths != b.lengths or bool(((a.values > 0) != (b.values > 0)).any())
    scores: list[tuple[float, float, str | None, int | None]] = []  # adjusted, unadjusted, text, byte
    byte_rows = []
    for k, d in enumerate(found.bytes):
        score, word = d.best(noise.bytes[k] if noise else None) if d else (0.0, SHIFT)
        if d:
            unadjusted = plain.bytes[k].best()[0] if plain else d.best()[0]
            scores.append((score, unadjusted, byte_text(k, word, score), k))
        reason = TOO_FEW if few else byte_text(k, word, score) if significant(score) else NONE
        byte_rows.append({
            "byte": k, "score": 0 if few else percent(score), "reason": reason if d else "", "bits": (d.bits if d and not few else np.zeros(8)).tolist(),
            "new_values": d.new[:16].tolist() if d and not few else [], "only_in_a": d.only_a.tolist() if d and not few else [], "counter": int(counter[k]), "checksum": int(checksum[k]),
        })
    if few:
        return {"score": 0, "reason": f"{TOO_FEW}; payloads differ" if differ else TOO_FEW, "bytes": byte_rows, "too_few": True, "payloads_differ": differ, "within_a": False}
    less = lambda name: max(getattr(found, name) - (getattr(noise, name) if noise else 0.0), 0.0)
    scores.append((less("length"), found.length, f"Length changes from {a.longest} to {b.longest} bytes", None))
    scores.append((less("fd"), found.fd, "Changes from classic CAN to CAN FD" if b.fd else "Changes from CAN FD to classic CAN", None))
    if found.ratio is not None:
        scores.append((less("rate"), found.rate, _rate_text(found.ratio) if found.ratio else None, None))
    best, text = 0.0, None
    for adjusted, _, said, _ in scores:
        if adjusted > best:
            best, text = adjusted, said
    within = bool(halves) and significant(max(s[1] for s in scores)) and not significant(best)
    reason = text if significant(best) else WITHIN if within else NONE
    return {"score": percent(best), "reason": reason, "bytes": byte_rows, "too_few": False, "payloads_differ": False, "within_a": within}
