"""Content-defined anchors: places that any two equal strings of WINDOW bytes have in common."""

from __future__ import annotations

import numpy as np

from tidemark.llm.common import mix64, powers, prefix_hash

#: Bytes of a match, and of the gram that is hashed at each place.
WINDOW, GRAM = 100, 37
#: Places in a window (64, so that flags of an anchor's windows fit a long).
SPAN = WINDOW - GRAM + 1
#: Windows are told apart by how far their anchor lies in: parts of PART places, whose windows all hold the same LONG bytes.
PART = 32
LONG = WINDOW - PART + 1
#: Low bits that hold a place while the smallest hash of a window is sought: of equal hashes the leftmost wins.
_PLACE = 26


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor and one part: (text, start, number of windows, long hash, anchor, anchor's hash).

    Every window of every text of WINDOW bytes or more is in exactly one run; windows don't cross texts. Anchor and part
    of a window depend on its bytes only, so equal windows have equal hashes and lie alike in their runs. The long hash
    is that of the LONG bytes that all windows of the anchor and part hold, and so seldom repeats by chance.
    """
    limit = 1 << _PLACE
    if len(data) <= limit:
        return _runs(data, offsets)
    # places must fit their bits: blocks that overlap by all but one byte of a window
    found = []
    for a in range(0, len(data) - WINDOW + 1, limit - WINDOW + 1):
        b = min(a + limit, len(data))
        first, last = np.searchsorted(offsets, a, side="right") - 1, np.searchsorted(offsets, b, side="left")
        text, start, count, long, anchor, h = _runs(data[a:b], np.clip(offsets[first : last + 1], a, b) - a)
        found.append((text + first, start + a, count, long, anchor + a, h))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """runs() of at most 1 << _PLACE bytes."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return (none,) * 6
    prefix = prefix_hash(data)
    _, down = powers(n + 1)
    with np.errstate(over="ignore"):
        hashes = mix64((prefix[GRAM:] - prefix[:-GRAM]) * down[: n - GRAM + 1])
    mask = np.uint64((1 << _PLACE) - 1)
    best = (hashes & ~mask) | (np.arange(len(hashes), dtype=np.uint64) & mask)
    width = 1
    while 2 * width <= SPAN:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < SPAN:
        best = np.minimum(best[: width - SPAN], best[SPAN - width :])
    head = np.empty(len(best), bool)
    head[0] = True
    np.not_equal(best[1:], best[:-1], out=head[1:])
    lengths = np.diff(offsets)
    head[offsets[:-1][lengths >= WINDOW]] = True
    # windows of one anchor that reach from the far part into the near one are two runs
    start = np.flatnonzero(head)
    near = (best[start] & mask).astype(np.int64) - (PART - 1)
    head[near[(start < near) & (near < np.r_[start[1:], len(best)])]] = True
    # runs are cut where texts end
    start = np.flatnonzero(head)
    text = np.repeat(np.arange(len(lengths)), np.diff(np.searchsorted(start, offsets)))
    last = (offsets[1:] - WINDOW + 1)[text]
    keep = start < last
    count = (np.minimum(np.r_[start[1:], len(best)], last) - start)[keep]
    start, text = start[keep], text[keep]
    anchor = (best[start] & mask).astype(np.int64)
    part = (anchor - start) // PART
    low = anchor - PART * part
    with np.errstate(over="ignore"):
        long = mix64((prefix[low + LONG] - prefix[low]) * down[low] + part.astype(np.uint64))
    return text, start, count, long.view(np.int64), anchor, hashes[anchor].view(np.int64)
