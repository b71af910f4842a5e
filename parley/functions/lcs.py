"""Per-pair longest-common-subsequence kernels (small Python helpers used
inside Arrow-batched pandas UDFs; Spark partitions the pairs).

``lcs_length`` is the bit-parallel LCS length (O(n * m / 64) word ops).
``lcs_indices`` reads one LCS out of the DP table with the common ROUGE
tie rule (move along the candidate only when that keeps a longer LCS).
"""

from __future__ import annotations

from collections import Counter

import numpy as np


def lcs_length(a: list, b: list) -> int:
    if not a or not b:
        return 0
    if len(b) > len(a):
        a, b = b, a
    masks: dict = {}
    for i, t in enumerate(a):
        masks[t] = masks.get(t, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for t in b:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


# above this many DP cells the read-out keeps only every ~sqrt(n)-th row and
# recomputes one block of rows at a time (same result, O(m * sqrt(n)) memory)
DP_CELLS = 20_000_000


def _codes(ref: list, can: list):
    codes: dict = {}
    can_ids = np.array([codes.setdefault(x, len(codes)) for x in can], dtype=np.int64)
    ref_ids = [codes.get(x, -1) for x in ref]
    return ref_ids, can_ids


def _next_row(prev: np.ndarray, rid: int, can_ids: np.ndarray) -> np.ndarray:
    """DP row i from row i-1: t[i][j] = max(t[i][j-1], eq ? t[i-1][j-1]+1 : t[i-1][j])."""
    row = np.empty_like(prev)
    row[0] = 0
    cand = np.where(can_ids == rid, prev[:-1] + 1, prev[1:])
    np.maximum.accumulate(cand, out=row[1:])
    return row


def lcs_table(ref: list, can: list) -> np.ndarray:
    """DP table t[i][j] = LCS(ref[:i], can[:j]), one vectorised row at a time."""
    n, m = len(ref), len(can)
    t = np.zeros((n + 1, m + 1), dtype=np.int32)
    if n == 0 or m == 0:
        return t
    ref_ids, can_ids = _codes(ref, can)
    for i in range(1, n + 1):
        prev = t[i - 1]
        cand = np.where(can_ids == ref_ids[i - 1], prev[:-1] + 1, prev[1:])
        np.maximum.accumulate(cand, out=t[i, 1:])
    return t


def lcs_indices(ref: list, can: list) -> list[int]:
    """Indices into ``ref`` of one LCS, read out from the bottom-right
    corner: diagonal on a match, else left when that keeps a longer LCS,
    else up."""
    n, m = len(ref), len(can)
    if n == 0 or m == 0:
        return []
    if (n + 1) * (m + 1) <= DP_CELLS:
        t = lcs_table(ref, can)
        row = lambda i: t[i]
    else:
        ref_ids, can_ids = _codes(ref, can)
        step = int(np.sqrt(n)) + 1
        saved = {0: np.zeros(m + 1, dtype=np.int32)}
        cur = saved[0]
        for i in range(1, n + 1):
            cur = _next_row(cur, ref_ids[i - 1], can_ids)
            if i % step == 0:
                saved[i] = cur
        cache: dict[int, np.ndarray] = {}

        def row(i: int) -> np.ndarray:
            if i not in cache:
                base = (i // step) * step
                cache.clear()
                r = saved[base]
                cache[base] = r
                for x in range(base + 1, min(base + step, n) + 1):
                    r = _next_row(r, ref_ids[x - 1], can_ids)
                    cache[x] = r
                if base > 0 and base - 1 not in cache:
                    # the row above the block is needed at its first row
                    prev_base = ((base - 1) // step) * step
                    r = saved[prev_base]
                    for x in range(prev_base + 1, base):
                        r = _next_row(r, ref_ids[x - 1], can_ids)
                    cache[base - 1] = r if base - 1 > prev_base else saved[prev_base]
            return cache[i]
    i, j = n, m
    out: list[int] = []
    while i > 0 and j > 0:
        if ref[i - 1] == can[j - 1]:
            out.append(i - 1)
            i -= 1
            j -= 1
        elif row(i)[j - 1] > row(i - 1)[j]:
            j -= 1
        else:
            i -= 1
    out.reverse()
    return out


def fmeasure(p: float, r: float) -> float:
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def rouge_l(target: list, pred: list) -> tuple[float, float, float]:
    if not target or not pred:
        return 0.0, 0.0, 0.0
    lcs = lcs_length(target, pred)
    p, r = lcs / len(pred), lcs / len(target)
    return p, r, fmeasure(p, r)


def rouge_lsum(target_sents: list[list], pred_sents: list[list]) -> tuple[float, float, float]:
    """Summary-level LCS: union of per-sentence LCS hits, clipped by counts."""
    if not target_sents or not pred_sents:
        return 0.0, 0.0, 0.0
    if len(target_sents) == 1 and len(pred_sents) == 1:
        # one sentence each: every LCS token is counted once, so this is ROUGE-L
        return rouge_l(target_sents[0], pred_sents[0])
    m = sum(len(s) for s in target_sents)
    n = sum(len(s) for s in pred_sents)
    if not m or not n:
        return 0.0, 0.0, 0.0
    cnt_t: Counter = Counter()
    cnt_p: Counter = Counter()
    for s in target_sents:
        cnt_t.update(s)
    for s in pred_sents:
        cnt_p.update(s)
    hits = 0
    for r in target_sents:
        union: set[int] = set()
        for c in pred_sents:
            union.update(lcs_indices(r, c))
        for i in sorted(union):
            tok = r[i]
            if cnt_p[tok] > 0 and cnt_t[tok] > 0:
                hits += 1
                cnt_p[tok] -= 1
                cnt_t[tok] -= 1
    p, rr = hits / n, hits / m
    return p, rr, fmeasure(p, rr)
