"""Edit counts of a (reference, hypothesis) pair.

Spark has no operator that returns *which kind* of edits a minimum-cost
alignment uses, and its ``levenshtein`` needs about 20 times the CPU of the
bit-parallel distance below on whole transcripts, so scoring is the one step
that runs in Python: a single Arrow-batched scalar UDF for words and
characters together.  It is row-local, needs no shuffle, and a hot group
spreads over tasks exactly as the scan did.

Inside a slice of a batch, equal pairs are scored once (the normalisation fan-out puts
the variants of a clip next to each other and many of them are equal), and
pairs of similar length are aligned together, one anti-diagonal at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTS_TYPE = T.StructType(
    [
        T.StructField("hits", T.LongType()),
        T.StructField("subs", T.LongType()),
        T.StructField("dels", T.LongType()),
        T.StructField("ins", T.LongType()),
        T.StructField("char_edits", T.LongType()),
        T.StructField("char_len", T.LongType()),
    ]
)

_SPACE_RUN = re.compile(r"\s\s+")

# Cells of one anti-diagonal held by one group of pairs: bounds the working
# set of a task (a few arrays of this many integers) whatever the batch holds.
_GROUP_CELLS = 1 << 16
# First width of the band that alignments are looked for in.
_BAND = 16
# The same for the 64-bit blocks of a group in the character distance.
_GROUP_BLOCKS = 1 << 13
# Texts of a batch that are Python strings and word numbers at a time, in bytes.
_SLICE_BYTES = 1 << 22


def score_tokens(text: str) -> list[str]:
    """Words as the metrics see them: runs of two or more whitespace
    characters act as a space, single tabs or newlines do not split."""
    return [w for w in _SPACE_RUN.sub(" ", text).strip().split(" ") if w]


# Whitespace of ``str.strip`` and of the pattern above, for RE2.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts (``score_tokens``) as numbers, equal words alike, and
    the offsets of each text's words.  No word becomes a Python string."""
    single = pc.replace_substring_regex(texts, f"[{_SPACES}]{{2,}}", " ")
    parts = pc.split_pattern(pc.utf8_trim(single, characters=_SPACES), " ")
    words = parts.flatten()
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    ends = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))])
    codes = words.filter(pa.array(full)).dictionary_encode().indices
    return codes.to_numpy().astype(np.int32), before[ends]


def _align_group(pairs: list[tuple[np.ndarray, np.ndarray]], band: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Edit distance and hits of several pairs, swept diagonal by diagonal,
    and the number of cells that took.

    Cell (i, j) lies on diagonal ``i + j``; arrays are indexed by ``i``, one
    column per pair.  Among equal-cost alignments the path is fixed: a
    deletion if it explains the cell's cost, else an insertion if the cell to
    the left is cheaper than the diagonal one, else the diagonal.

    With a ``band``, only cells are swept whose offset ``j - i`` is at most so
    far outside of 0 and ``m - n``.  Distances up to ``|m - n| + 2 * band`` and
    the hits with them are then those of the whole table: all cells of all
    paths of that cost lie in the band, so they have their costs, and others
    have no less than theirs.  At a cell of the path, the deletion, or a cheaper
    cell to the left, is chosen only if it is on such a path itself.
    """
    width = len(pairs)
    n = np.array([len(r) for r, _ in pairs])
    m = np.array([len(h) for _, h in pairs])
    rows, cols = int(n.max()), int(m.max())
    kind = np.int16 if rows + cols < 32000 else np.int32
    far = np.iinfo(kind).max - 8
    low, high = -rows, cols
    if band is not None:
        low, high = min(0, int((m - n).min())) - band, max(0, int((m - n).max())) + band

    ref = np.full((rows, width), -1, dtype=np.int32)
    # The hypothesis is stored backwards so that a diagonal is a plain slice.
    hyp = np.full((cols, width), -2, dtype=np.int32)
    for b, (r, h) in enumerate(pairs):
        ref[: len(r), b] = r
        hyp[cols - len(h) :, b] = h[::-1]

    finish = np.argsort(n + m, kind="stable")
    ends = (n + m)[finish]
    edits = np.zeros(width, dtype=np.int64)
    hits = np.zeros(width, dtype=np.int64)

    cost2 = np.zeros((rows + 1, width), dtype=kind)
    cost1, cost0 = cost2.copy(), cost2.copy()
    # What lies beside the first cell is out of reach.
    cost1[1:] = far
    cost2[:] = far
    hit2, hit1, hit0 = np.zeros_like(cost0), np.zeros_like(cost0), np.zeros_like(cost0)
    done, cells = int(np.searchsorted(ends, 0, side="right")), 0
    for k in range(1, int(ends[-1]) + 1):
        first = max(0, k - cols, -((high - k) // 2))
        last = min(rows, k, (k - low) // 2)
        lo, hi = max(1, first), min(last, k - 1)
        if lo <= hi:
            cells += hi - lo + 1
            up, left, diag = cost1[lo - 1 : hi], cost1[lo : hi + 1], cost2[lo - 1 : hi]
            same = ref[lo - 1 : hi] == hyp[cols - k + lo : cols - k + hi + 1]
            cell = np.minimum(up, left)
            cell += 1
            np.minimum(cell, diag + ~same, out=cell)
            cost0[lo : hi + 1] = cell
            path = hit2[lo - 1 : hi] + same
            np.copyto(path, hit1[lo : hi + 1], where=left == diag - 1)
            np.copyto(path, hit1[lo - 1 : hi], where=cell == up + 1)
            hit0[lo : hi + 1] = path
        if first == 0:
            cost0[0], hit0[0] = k, 0
        if last == k:
            cost0[k], hit0[k] = k, 0
        if first > 0:
            cost0[first - 1] = far
        if last < rows:
            cost0[last + 1] = far
        while done < width and ends[done] == k:
            b = finish[done]
            edits[b], hits[b] = cost0[n[b], b], hit0[n[b], b]
            done += 1
        cost2, cost1, cost0 = cost1, cost0, cost2
        hit2, hit1, hit0 = hit1, hit0, hit2
    return edits, hits, cells * width


def align_token_pairs(pairs: Iterable[tuple[list[str], list[str]]]) -> np.ndarray:
    """``(len(pairs), 4)`` array of hits, subs, dels, ins."""
    codes: dict[str, int] = {}
    coded = [tuple(np.array([codes.setdefault(w, len(codes)) for w in side], np.int32) for side in pair) for pair in pairs]
    return align_coded(coded)


def align_coded(pairs: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The same for words that are numbers.

    Common ends are taken off.  Pairs of similar length are swept together in a
    narrow band; those that need more are swept again in one up to four times
    as wide, so that a pair costs about its length times its edits.
    """
    shape, todo = [], []
    for index, (r, h) in enumerate(pairs):
        limit = min(len(r), len(h))
        head = _common(r[:limit], h[:limit])
        tail = _common(r[head:][::-1][: limit - head], h[head:][::-1][: limit - head])
        shape.append((len(r), len(h), head + tail))
        r, h = r[head : len(r) - tail], h[head : len(h) - tail]
        if len(r) and len(h):
            todo.append((index, r, h))

    out = np.zeros((len(shape), 4), dtype=np.int64)
    if not shape:
        return out
    n, m, affix = np.array(shape, dtype=np.int64).T
    edits = np.maximum(n - affix, m - affix)
    hits = affix.copy()

    todo.sort(key=lambda t: (len(t[1]) + len(t[2]), len(t[1])))
    band = _BAND
    while todo:
        start, wider, enough = 0, [], 0
        while start < len(todo):
            stop, tallest = start, 0
            while stop < len(todo):
                tallest = max(tallest, len(todo[stop][1]) + 1)
                if stop > start and tallest * (stop + 1 - start) > _GROUP_CELLS:
                    break
                stop += 1
            group = todo[start:stop]
            whole = tallest <= 2 * band
            e, k, _ = _align_group([(r, h) for _, r, h in group], None if whole else band)
            at = np.array([i for i, _, _ in group])
            apart = np.array([abs(len(h) - len(r)) for _, r, h in group])
            sure = np.full(len(group), True) if whole else e <= apart + 2 * band
            edits[at[sure]] = e[sure]
            hits[at[sure]] += k[sure]
            wider += [t for t, ok in zip(group, sure) if not ok]
            # What was found is never too small: this band will do.
            enough = max([enough, *((e - apart + 1) // 2)[~sure].tolist()])
            start = stop
        todo, band = wider, min(4 * band, enough)

    dels = hits - m + edits
    ins = hits - n + edits
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = hits, edits - dels - ins, dels, ins
    return out


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    differ = a != b
    return int(differ.argmax()) if differ.any() else len(a)


def _distance_group(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Levenshtein distances of (longer, shorter) pairs of code points.

    Bit-parallel: a column of the distance matrix is held as the bits of the
    rows where the cost goes up or down by one, 64 rows to a block.  Block
    ``w`` works on character ``t - w`` at step ``t``, so that all blocks of
    all pairs advance in the same array operations, each with the carries
    that the block below left one step before.
    """
    width = len(pairs)
    rows = np.array([len(a) for a, _ in pairs])
    steps = np.array([len(b) for _, b in pairs])
    blocks = int(rows.max() + 63) // 64
    longest = int(steps.max())

    # Rows of each (pair, character) as bits; row 0 is a character not there.
    owner = np.repeat(np.arange(width, dtype=np.int64), rows)
    place = np.concatenate([np.arange(n) for n in rows])
    keys = (owner << 21) | np.concatenate([a for a, _ in pairs])
    known, inverse = np.unique(keys, return_inverse=True)
    bits = np.zeros((len(known) + 1, blocks), dtype=np.uint64)
    np.bitwise_or.at(bits, (inverse + 1, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    bits = bits.ravel()

    asked = (np.repeat(np.arange(width, dtype=np.int64), steps) << 21) | np.concatenate(
        [b for _, b in pairs]
    )
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    at = np.where(known[at] == asked, at + 1, 0) * blocks
    # Character of each pair by step, after as many unused rows as there are
    # blocks: block w reads w rows further up.
    chars = np.zeros((longest + 2 * blocks, width), dtype=np.int64)
    chars[np.concatenate([np.arange(m) for m in steps]) + blocks, np.repeat(np.arange(width), steps)] = at

    # When the last character of a pair has passed a block, its bits count.
    block = np.arange(blocks)[:, None]
    due = (steps[None, :] - 1 + block).ravel()
    turn = np.argsort(due, kind="stable")
    due = due[turn]
    inside = np.clip(rows[None, :] - 64 * block, 0, 64).ravel()
    mask = np.where(
        inside == 64,
        np.uint64(0xFFFFFFFFFFFFFFFF),
        (np.uint64(1) << (inside % 64).astype(np.uint64)) - np.uint64(1),
    )

    distance = steps.astype(np.int64)
    one, top = np.uint64(1), np.uint64(63)
    up = np.full((blocks, width), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    down = np.zeros_like(up)
    # Carries into each block; the matrix starts with +1 steps along its top.
    plus, minus = np.zeros_like(up), np.zeros_like(up)
    plus[0] = 1
    done = 0
    for t in range(longest + blocks - 1):
        k = min(blocks, t + 1)
        window = chars[t + blocks - k + 1 : t + blocks + 1][::-1]
        match = bits.take(window + block[:k])
        p, n, cp, cm = up[:k], down[:k], plus[:k], minus[:k]
        fixed = match | n
        match |= cm
        keep = (((match & p) + p) ^ p) | match
        right = n | ~(keep | p)
        left = p & keep
        carry_right, carry_left = right >> top, left >> top
        right = (right << one) | cp
        left = (left << one) | cm
        np.bitwise_or(left, ~(fixed | right), out=p)
        np.bitwise_and(right, fixed, out=n)
        higher = min(k, blocks - 1)
        plus[1 : higher + 1], minus[1 : higher + 1] = carry_right[:higher], carry_left[:higher]
        if done < len(due) and due[done] == t:
            stop = int(np.searchsorted(due, t, side="right"))
            cells = turn[done:stop]
            gain = np.bitwise_count(up.ravel()[cells] & mask[cells]).astype(np.int64)
            gain -= np.bitwise_count(down.ravel()[cells] & mask[cells])
            np.add.at(distance, cells % width, gain)
            done = stop
    return distance


def char_distances(pairs: Iterable[tuple[str, str]]) -> np.ndarray:
    """Levenshtein distance over code points of every pair."""
    out, todo = [], []
    for index, (left, right) in enumerate(pairs):
        a, b = _code_points(left), _code_points(right)
        if len(a) < len(b):
            a, b = b, a
        head = _common(a[: len(b)], b)
        a, b = a[head:], b[head:]
        tail = _common(a[len(a) - len(b) :][::-1], b[::-1])
        a, b = a[: len(a) - tail], b[: len(b) - tail]
        out.append(len(a))
        if len(b):
            todo.append((index, a, b))
    distances = np.array(out, dtype=np.int64)

    todo.sort(key=lambda t: (len(t[1]), len(t[2])))
    start = 0
    while start < len(todo):
        stop, blocks = start, 0
        while stop < len(todo):
            blocks = len(todo[stop][1]) // 64 + 1
            if stop > start and blocks * (stop + 1 - start) > _GROUP_BLOCKS:
                break
            stop += 1
        group = todo[start:stop]
        distances[[i for i, _, _ in group]] = _distance_group([(a, b) for _, a, b in group])
        start = stop
    return distances


def count_pairs(pairs: Sequence[tuple[str, str]], words: bool, chars: bool) -> pa.Array:
    """Counts of each (reference, hypothesis), as an array of ``COUNTS_TYPE``
    structs; fields that are not asked for are NULL."""
    where: dict[tuple[str, str], int] = {}
    slot = np.array([where.setdefault(p, len(where)) for p in pairs], dtype=np.int64)
    fields = [pa.nulls(len(pairs), pa.int64())] * 6
    if words:
        codes, offsets = word_codes(pa.array([*(r for r, _ in where), *(h for _, h in where)], pa.string()))
        sides = [codes[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        table = align_coded(list(zip(sides[: len(where)], sides[len(where) :])))
        fields[:4] = [pa.array(table[slot, i]) for i in range(4)]
    if chars:
        stripped = [(r.strip(), h.strip()) for r, h in where]
        sizes = np.array([len(r) for r, _ in stripped], dtype=np.int64)
        fields[4:] = [pa.array(c[slot]) for c in (char_distances(stripped), sizes)]
    return pa.StructArray.from_arrays(fields, names=COUNTS_TYPE.names)


def _spread_over(known: pa.Array, values: pa.Array) -> pa.Array:
    """``values`` at the places where ``known`` is true, NULL elsewhere."""
    place = pc.cumulative_sum(pc.cast(known, pa.int64()))
    return values.take(pc.if_else(known, pc.subtract(place, 1), pa.scalar(None, pa.int64())))


def count_in_slices(ref: pa.Array, hyp: pa.Array, words: bool, chars: bool) -> pa.Array:
    """Counts of the pairs of two arrays, NULL where a side is.

    Pairs are scored a slice of about ``_SLICE_BYTES`` at a time: what is held
    beside the arrays doesn't grow with the batch.  A longer pair is a slice of
    its own.
    """
    known = pc.and_(ref.is_valid(), hyp.is_valid())
    ref, hyp = ref.filter(known), hyp.filter(known)
    sizes = [pc.binary_length(side).to_numpy(zero_copy_only=False).astype(np.int64) for side in (ref, hyp)]
    ends = np.concatenate([[0], np.cumsum(sizes[0] + sizes[1])])
    counts, start = [], 0
    while start < len(ref) or not counts:
        stop = int(np.searchsorted(ends, ends[start] + _SLICE_BYTES, side="right")) - 1
        size = max(stop, start + 1) - start
        pairs = zip(ref.slice(start, size).to_pylist(), hyp.slice(start, size).to_pylist(), strict=True)
        counts.append(count_pairs(list(pairs), words, chars))
        start += size
    return _spread_over(known, pa.concat_arrays(counts))


def edit_counts(
    ref: Column | str, hyp: Column | str, *, words: bool = True, chars: bool = True
) -> Column:
    """``struct<hits, subs, dels, ins, char_edits, char_len>``.

    Word fields are NULL without ``words``, character fields without
    ``chars``, the whole struct where a side is NULL.
    """

    def batch(r: pa.Array, h: pa.Array) -> pa.Array:
        return count_in_slices(r, h, words, chars)

    return F.arrow_udf(batch, COUNTS_TYPE)(ref, hyp)


def edit_counts_of_variants(
    variants: Column | str, *, words: bool = True, chars: bool = True
) -> Column:
    """The same for ``array<struct<reference, hypothesis>>``: an array of
    counts, NULL where the variant is NULL.  All normalisations of a clip
    reach Python in one row, so equal ones are scored once."""

    def batch(lists: pa.Array) -> pa.Array:
        counts = count_in_slices(*lists.flatten().flatten(), words, chars)
        sizes = pc.list_value_length(lists).fill_null(0)
        offsets = pa.concat_arrays(
            [pa.array([0], pa.int32()), pc.cast(pc.cumulative_sum(sizes), pa.int32())]
        )
        return pa.ListArray.from_arrays(offsets, counts)

    return F.arrow_udf(batch, T.ArrayType(COUNTS_TYPE))(variants)
