"""Edit distances by bit-parallel dynamic programming over arbitrary-length integers."""

from __future__ import annotations


def masks(pattern: str) -> dict[str, int]:
    """For each character, the positions at which the pattern has it."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_ending(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Myers: the least distance between the pattern (of length m) and any substring of text, and where such ends (first)."""
    if m == 0:
        return 0, 0
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, 0
    for i, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph <<= 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
        if score < best:
            best, at = score, i + 1
    return best, at


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance of a and b is k at most: Myers's columns on a band of 2k+1 diagonals (Hyyro).

    Bit j of a column stands for row i - k + j at column i, so a column needs 2k+1 bits however long the strings are.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(b), len(a)  # columns run over b, rows over a
    if m - n > k:
        return False
    if k == 0 or not n:
        return a == b if k == 0 else m <= k
    # common ends cost nothing
    lo = 0
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[m - 1 - hi] == b[n - 1 - hi]:
        hi += 1
    a, b = a[lo : m - hi], b[lo : n - hi]
    m, n = len(a), len(b)
    if n == 0:
        return m <= k
    width = 2 * k + 1
    full = (1 << width) - 1
    where = masks(a)
    # vertical deltas of the band's rows at column 0; rows above row 1 count as equal steps
    pv, mv = (full << (k)) & full, 0
    score = k  # of the band's last row, row k at column 0
    for i in range(1, n + 1):
        at = i - 1 - k  # a's index of the band's first row in this column
        eq = where.get(b[i - 1], 0)
        eq = (eq >> at if at >= 0 else eq << -at) & full
        d0 = (((eq & pv) + pv) ^ pv) | eq | mv
        hp = mv | (~(d0 | pv) & full)
        hn = d0 & pv
        # the band moves down a row with each column: its last row is one below the last of the column before
        x = d0 >> 1
        pv, mv = (hn | (~(x | hp) & full)) & full, hp & x
        score += 0 if d0 >> (width - 1) & 1 else 1
    # score is now the distance at row n + k (rows past m don't exist: step back along the vertical deltas)
    row = n + k
    j = width - 1
    while row > m:
        # vertical delta between row and row - 1 of the last column sits at bit j - 1 after the shift
        score -= (pv >> (j - 1) & 1) - (mv >> (j - 1) & 1)
        row -= 1
        j -= 1
    return score <= k
