"""N-gram Jaccard join as a blocked sparse matrix product, and the components of its links.

Rows of the incidence matrix are the distinct shingle sets, columns are shingles
(64-bit hashes). Two sets can reach the threshold t only if they share one of the first
n - ceil(t * n) + 1 columns of each row, in any one order of the columns that all rows
use. So the product is formed over those columns alone, cut into blocks of columns:
a task holds one block, finds the rows that meet in a column, and drops pairs whose
sizes, or whose entries left after that column, can't reach the bound. What is left is
counted exactly, row against row.

Order of columns: those seen in many sets come last, rarest of them first, so common
lines and passages hardly ever select pairs. It only has to be one order; how exactly
the frequent columns were found changes the work and never the result.

Columns whose list is long even so belong to large groups of near copies. There, pairs
are not enumerated: each list pairs its rows with its most typical row (one pair per row).
Pairs are first compared by short vectors, the row's first columns, of which linking rows
share a known number; what is left is counted exactly, and components are formed. Rows whose
long lists have one typical row form a group, so rows that meet in a long list share a group.
Groups that are one component by then hold nothing new. The others are cut into blocks of rows,
of GROUP_ROWS rows and GROUP_ENTRIES entries at most. For each two blocks the product of their
short vectors leaves the rows that may link to another component, and the product of those
rows' sets gives all their overlaps at once; of the links, those that span the block's components
are returned, so output stays linear. No link between rows of different components stays
unchecked, so the components are exact; only links inside a component may stay uncounted there.
That is all that `keep_one` and `jaccard_components` need.

The join itself, `jaccard_links` and `link_pairs`, counts every link: pairs from short lists that no long list
gathers are counted one by one, and all groups go through the block products, of which each
pair of rows is taken in one group and one block pair only.

Scale: texts are read five times and shuffled only by `keep_one`, once; what is shuffled are about
15 % of the shingles, once, and the sets of rows that have candidates. Frequent columns go
to Python as a table of at most TOP_COLUMNS rows, and so do their typical rows to a join. Rows
that are needed go there as a filter of FILTER_BITS for each row, up to 2**MOST_BITS bits (8 MB);
with more than some ten million such rows it lets more and more others pass, which a join drops.
Tables between steps are deleted as soon as nothing reads them any more.

Defined cases: null or empty texts and texts without words have an empty set and link
with nothing; fewer words than `width` make one shingle of the whole sequence; repeated
rows and equal sets form one class; doc_id is a number, a null one takes part, and a component's id is its
least doc_id that isn't null; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, bounded_batches, lean, release, stash, text_frame
from .components import components

WIDTH, PERCENT = 4, 85
#: A column seen so often within one task's share counts as a candidate for a frequent column.
LOCAL_COUNT, FREQUENT, TOP_COLUMNS = 2, 16, 131_072
#: Lists up to this length give all their pairs; longer ones go by typical rows and components.
SHORT_LIST = 8
#: Entries of the matrix in one block.
BLOCK_ROWS = 250_000
#: Vectors compared before whole sets hold (1 + HEAD_PARTS) times the slack n - needed.
HEAD_PARTS = 1
#: Rows and entries of one block when all rows that met in long lists are compared.
GROUP_ROWS, GROUP_ENTRIES = 1024, 1_000_000
#: Bits for each row of the filter that tells which rows have candidates; its size is two to the power of MOST_BITS at most.
FILTER_BITS, MOST_BITS = 16, 26
#: Entries held while columns are counted, and names of sets held so that copies are worked on once.
HELD, NAMES = 500_000, 100_000

_MULTIPLY = tuple(np.uint64(int.from_bytes(hashlib.sha256(bytes([k])).digest()[:8], "big") | 1) for k in range(64))
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
#: Bytes of texts whose words are hashed together.
_PIECE = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each bit depends on all."""
    x = (x ^ (x >> np.uint64(33))) * _MULTIPLY[62]
    x = (x ^ (x >> np.uint64(29))) * _MULTIPLY[63]
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Distinct shingle hashes of texts, rising.

    A word's hash is a polynomial of its bytes modulo 2**64, taken for all words of a
    piece at once from running sums: the base is odd, so its powers can be divided out.
    """

    def __init__(self, width: int):
        self.width = width
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            base = int(_MULTIPLY[60])
            n = max(n, _PIECE)
            steps = np.repeat(np.array([[base], [pow(base, -1, 2**64)]], np.uint64), n, axis=1)
            steps[:, 0] = 1
            self.powers, self.inverse = np.cumprod(steps, axis=1)

    def batch(self, column: pa.Array):
        """The set of each text of a string column, in order; null texts have the empty set."""
        column = column.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _PIECE, side="right")) - 1)
            last = min(last, len(column))
            yield from self._piece(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            first = last

    def _piece(self, data: np.ndarray, bounds: np.ndarray):
        none = np.empty(0, np.uint64)
        if not len(data):
            yield from (none for _ in bounds[1:])
            return
        self._reach(len(data) + 1)
        data = _LOWER[data]
        space = _SPACE[data]
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        before[bounds[bounds < len(data)]] = True
        after[bounds[bounds > 0] - 1] = True
        start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
        words = _mix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * _MULTIPLY[61])
        at = np.searchsorted(start, bounds)
        full = self._combine(words, self.width) if len(words) >= self.width else none
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            n = b - a
            if n < self.width:
                yield self._combine(words[a:b], n) if n else none
                continue
            got = np.sort(full[a : b - self.width + 1])
            fresh = got[1:] != got[:-1]
            yield got if fresh.all() else got[np.r_[True, fresh]]

    @staticmethod
    def _combine(words: np.ndarray, width: int) -> np.ndarray:
        n = len(words) - width + 1
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = out * _MULTIPLY[k] + words[k : k + n]
        return _mix(out)


def set_id(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    got = np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64)
    return int(got[0]), int(got[1])


def needed(n, percent):
    """Entries that a set of n shares with any set it links to, at least."""
    return (percent * n + 99) // 100


def reaches(overlap, a, b, percent):
    """Whether sets of a and b entries with that overlap link."""
    return 100 * overlap >= percent * (a + b - overlap)


def _long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


_ROWS = pa.schema([("doc_id", pa.int64()), ("content", pa.binary()), ("n", pa.int64()), ("row", pa.int64()), ("row2", pa.int64()), ("column", pa.int64()), ("seen", pa.int64())])


def _rows_and_counts(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """A row per document (its set's size and id); and rows with counts of columns that one task saw several times."""

    def run(batches):
        shingles, sets, held, size = Shingler(width), set(), [], 0

        def flush():
            columns, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= LOCAL_COUNT
            none = pa.nulls(int(keep.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.nulls(len(none), pa.binary()), none, none, none, pa.array(_long(columns[keep])), pa.array(counts[keep])], schema=_ROWS)

        for batch in batches:
            n, row, row2 = [], [], []
            for tokens in shingles.batch(batch.column(2)):
                name = set_id(tokens)
                n.append(len(tokens))
                row.append(name[0])
                row2.append(name[1])
                if n[-1] and name not in sets:
                    sets.add(name)
                    held.append(tokens[: int(1.25 * (n[-1] - needed(n[-1], percent))) + 2])
                    size += len(held[-1])
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.binary()), *(pa.array(x, pa.int64()) for x in (n, row, row2)), none, none], schema=_ROWS)
            if size > HELD:
                yield flush()
                held, size = [], 0
                sets.clear()
        if held:
            yield flush()

    return docs.mapInArrow(lean(run), "doc_id long, content binary, n long, row long, row2 long, column long, seen long")


def _in_order(tokens: np.ndarray, columns: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, int]:
    """Tokens in the order of columns, which of them are frequent, and how typical the row is."""
    if len(columns):
        at = np.minimum(np.searchsorted(columns, tokens), len(columns) - 1)
        many = columns[at] == tokens
        if many.any():
            counts = np.where(many, seen[at], 0)
            return tokens[np.lexsort((tokens, counts))], np.sort(many), min(int(counts.sum() // len(tokens)), 2**31 - 1)
    return tokens, None, 0


_ENTRIES = pa.schema([("column", pa.int64()), ("row", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("typical", pa.int32()), ("frequent", pa.bool_())])


def _entries(docs: DataFrame, frequent, width: int, percent: int) -> DataFrame:
    """The matrix's entries in each row's first columns; once for each set and task."""

    def run(batches):
        columns, seen = frequent.value
        shingles, sets = Shingler(width), set()
        for batch in batches:
            parts = []
            for tokens in shingles.batch(batch.column(0)):
                n = len(tokens)
                if not n or (name := set_id(tokens)) in sets:
                    continue
                sets.add(name)
                first = n - needed(n, percent) + 1
                tokens, many, typical = _in_order(tokens, columns, seen)
                take = tokens[:first]
                parts.append((take, name[0], n, typical, np.zeros(len(take), bool) if many is None else many[:first]))
            if len(sets) > NAMES:
                sets.clear()
            if parts:
                sizes = [len(p[0]) for p in parts]
                spread = lambda k, kind: np.repeat(np.array([p[k] for p in parts], kind), sizes)  # noqa: B023
                yield pa.RecordBatch.from_arrays([pa.array(_long(np.concatenate([p[0] for p in parts]))), pa.array(spread(1, np.int64)), pa.array(spread(2, np.int32)), pa.array(np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])), pa.array(spread(3, np.int32)), pa.array(np.concatenate([p[4] for p in parts]))], schema=_ENTRIES)

    return docs.select("text").mapInArrow(lean(run), "column long, row long, n int, place int, typical int, frequent boolean")


#: What _FOUND's rows say: rows x and y may link; y of n entries belongs to the group of x of m entries; frequent column x has row y of n entries, typical to the degree m.
PAIR, MEMBER, FREQUENT_ENTRY = range(3)
_FOUND = pa.schema([("kind", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("n", pa.int32()), ("m", pa.int32())])


def _block_product(percent: int, short_list: int):
    """Pairs that meet in the block's short lists, the rows of each long list with its most typical row, and entries of frequent columns as they are."""

    def made(kind, x, y, n, m):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), *(pa.array(c) for c in (x, y)), *(pa.array(c.astype(np.int32, copy=False)) for c in (n, m))], schema=_FOUND)

    def pairs(left, right):
        both = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)], axis=1), axis=0)
        none = np.zeros(len(both), np.int32)
        return made(PAIR, np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]), none, none)

    def run(batches):
        held = []
        for batch in batches:
            arrays = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            if (many := arrays[5].astype(bool)).any():
                column, row, n, _, typical = (x[many] for x in arrays[:5])
                yield made(FREQUENT_ENTRY, column, row, n, typical)
                arrays = [x[~many] for x in arrays]
            held.append(arrays[:5])
        if not held:
            return
        column, row, n, place, typical = (np.concatenate([h[k] for h in held]) for k in range(5))
        del held
        order = np.lexsort((row, column))
        column, row, n, place, typical = (x[order] for x in (column, row, n, place, typical))
        fresh = np.ones(len(column), bool)
        fresh[1:] = (column[1:] != column[:-1]) | (row[1:] != row[:-1])  # copies that several tasks met
        column, row, n, place, typical = (x[fresh] for x in (column, row, n, place, typical))
        starts = np.flatnonzero(np.r_[True, column[1:] != column[:-1]]) if len(column) else np.empty(0, int)
        lengths = np.diff(np.r_[starts, len(column)])
        for s, k in zip(starts[lengths > short_list], lengths[lengths > short_list], strict=True):
            rows, sizes = row[s : s + k], n[s : s + k]
            head = np.lexsort((rows, typical[s : s + k]))[-1]
            yield made(MEMBER, np.full(k, rows[head]), rows, sizes, np.full(k, sizes[head]))
        left, right, size = [], [], 0
        for step in range(1, short_list):  # entry i of a list against entry i + step
            of = np.repeat(lengths, lengths)
            inside = np.arange(len(column)) - np.repeat(starts, lengths)
            i = np.flatnonzero((of <= short_list) & (inside + step < of))
            if not len(i):
                break
            j = i + step
            rest = np.minimum(n[i] - place[i], n[j] - place[j]).astype(np.int64)
            ok = reaches(rest, n[i].astype(np.int64), n[j], percent)
            left.append(row[i[ok]])
            right.append(row[j[ok]])
            size += int(ok.sum())
            if size > 500_000:
                yield pairs(np.concatenate(left), np.concatenate(right))
                left, right, size = [], [], 0
        if size:
            yield pairs(np.concatenate(left), np.concatenate(right))

    return lean(run)


def _row_filter(wanted: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, words): a bit for each wanted row's hash; words of 64 of them are put together before they reach the driver."""
    bits = min(MOST_BITS, max(16, (FILTER_BITS * wanted.count()).bit_length()))
    at = F.col("row").bitwiseAND(2**bits - 1)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    got = wanted.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()  # 2**(MOST_BITS - 6) rows
    words = np.zeros(2 ** (bits - 6), np.uint64)
    words[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return bits, words


def _vectors(docs: DataFrame, wanted: DataFrame, frequent, width: int, percent: int, head: bool) -> DataFrame:
    """(row, tokens) of the wanted rows: their sets, or, for head, the first HEAD_PARTS parts of their slack in column order, 32 bits each."""
    wanted = stash(wanted.select("row").distinct(), "ngram-wanted")
    shipped = docs.sparkSession.sparkContext.broadcast(_row_filter(wanted))

    def run(batches):
        bits, words = shipped.value
        columns, seen = frequent.value
        shingles, sets = Shingler(width), set()
        for batch in batches:
            rows, rows2, values = [], [], []
            for tokens in shingles.batch(batch.column(0)):
                if not len(tokens):
                    continue
                row, row2 = set_id(tokens)
                at = row & (2**bits - 1)
                if int(words[at >> 6]) >> (at & 63) & 1 and (row, row2) not in sets:
                    sets.add((row, row2))
                    rows.append(row)
                    rows2.append(row2)
                    if head:
                        n = len(tokens)
                        first = _in_order(tokens, columns, seen)[0][: n - needed(n, percent) + _guaranteed(n, percent)]
                        values.append(np.array([n], np.uint32).tobytes() + np.sort((first >> np.uint64(32)).astype(np.uint32)).tobytes())
                    else:
                        values.append(tokens.tobytes())
            if len(sets) > NAMES:
                sets.clear()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(rows2, pa.int64()), pa.array(values, pa.binary())], ["row", "row2", "tokens"])

    found = docs.select("text").mapInArrow(lean(run), "row long, row2 long, tokens binary")
    out = stash(found.join(wanted, "row", "left_semi").groupBy("row").agg(F.min_by("tokens", "row2").alias("tokens")), "ngram-vectors")
    release(wanted)
    shipped.unpersist()
    return out


def _guaranteed(n, percent):
    """Entries that two linking rows share among the first n - needed + guaranteed of each, at least."""
    return 1 + HEAD_PARTS * (n - needed(n, percent))


def _common(short: np.ndarray, long: np.ndarray) -> int:
    """Equal entries of two rising arrays, repeats counted as often as short has them."""
    if not len(short) or not len(long):
        return 0
    at = np.minimum(np.searchsorted(long, short), len(long) - 1)
    return int((long[at] == short).sum())


def _compare(pairs: DataFrame, vectors: DataFrame, percent: int, head: bool) -> DataFrame:
    """Those of the pairs (a, b) whose vectors pass, with the entries in common: for head those that can link, else those that do."""

    def run(batches):
        for batch in batches:
            ok, common, last, value = [], [], None, None
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x = x.as_buffer()
                if last is None or not x.equals(last):
                    last, value = x, np.frombuffer(x, np.uint32 if head else np.uint64)
                other = np.frombuffer(y.as_buffer(), np.uint32 if head else np.uint64)
                if head:
                    n, m = int(value[0]), int(other[0])
                    k = max(_common(value[1:], other[1:]), _common(other[1:], value[1:]))
                    ok.append(100 * min(n, m) >= percent * max(n, m) and k >= _guaranteed(min(n, m), percent))
                else:
                    n, m = len(value), len(other)
                    k = _common(value, other) if n < m else _common(other, value)
                    ok.append(bool(reaches(k, n, m, percent)))
                common.append(k)
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64())], ["a", "b", "overlap"]).filter(ok)

    one = pairs.select("a", "b").join(vectors.select(F.col("row").alias("b"), F.col("tokens").alias("tb")), "b")
    both = one.join(vectors.select(F.col("row").alias("a"), F.col("tokens").alias("ta")), "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(lean(run), "a long, b long, overlap long")


def _overlaps(vectors: list[np.ndarray]) -> np.ndarray:
    """Entries in common of all pairs: the product of the incidence rows with their transpose, column block by column block."""
    owner = np.repeat(np.arange(len(vectors)), [len(v) for v in vectors])
    columns = np.concatenate(vectors)
    order = np.argsort(columns, kind="stable")
    owner, columns = owner[order], columns[order]
    starts = np.flatnonzero(np.r_[True, columns[1:] != columns[:-1]]) if len(columns) else np.empty(0, int)
    lengths = np.diff(np.r_[starts, len(columns)])
    shared = np.repeat(lengths > 1, lengths)
    owner, at = owner[shared], np.repeat(np.arange(int((lengths > 1).sum())), lengths[lengths > 1])
    overlap = np.zeros((len(vectors), len(vectors)), np.float32)
    for low in range(0, int((lengths > 1).sum()), 2048):
        first, last = np.searchsorted(at, (low, low + 2048))
        part = np.zeros((len(vectors), at[last - 1] - low + 1), np.float32)
        part[owner[first:last], at[first:last] - low] = 1
        overlap += part @ part.T
    return overlap


def _group_live(percent: int):
    """Rows of a block pair that may link to a row of another component, by their short vectors."""

    def run(table: pa.Table) -> pa.Table:
        heads = [np.frombuffer(t, np.uint32) for t in table.column("tokens").to_pylist()]
        n = np.array([h[0] for h in heads], np.int64)
        vectors = [np.unique(h[1:]) for h in heads]
        lost = np.array([len(h) - 1 - len(v) for h, v in zip(heads, vectors, strict=True)])
        component = table.column("component").to_numpy()
        least = np.minimum(n[:, None], n[None, :])
        may = _overlaps(vectors) >= _guaranteed(least, percent) - lost[:, None] - lost[None, :]
        may &= (100 * least >= percent * np.maximum(n[:, None], n[None, :])) & (component[:, None] != component[None, :])
        return table.select(["head", "x", "y", "row"]).filter(pa.array(may.any(axis=1)))

    return run


def _group_forest(percent: int):
    """Links that span the components of a block pair's rows, by a product of their incidence rows."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.column("row").to_numpy()
        sets = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
        n = np.array([len(t) for t in sets], np.int64)
        overlap = _overlaps(sets)
        linked = 100 * overlap >= percent * (n[:, None] + n[None, :] - overlap)
        a, b, left = [], [], np.ones(len(rows), bool)
        for seed in range(len(rows)):  # each row once
            if not left[seed]:
                continue
            left[seed], queue = False, [seed]
            while queue:
                i = queue.pop()
                new = np.flatnonzero(linked[i] & left)
                left[new] = False
                a += [rows[i]] * len(new)
                b += rows[new].tolist()
                queue += new.tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _counted_here(table: pa.Table) -> np.ndarray:
    """Which pairs of a block pair's rows are counted there: those that no lesser head gathers and no other block pair has."""
    head, x, y = (table.column(c)[0].as_py() for c in ("head", "x", "y"))
    block = table.column("block").to_numpy()
    lesser = [np.array([h for h in heads if h < head], np.int64) for heads in table.column("heads").to_pylist()]
    here = _overlaps(lesser) == 0
    if x != y:
        here &= block[:, None] != block[None, :]
    np.fill_diagonal(here, False)
    return here


def _group_candidates(percent: int):
    """Rows of a block pair that may link to any row there, by their short vectors."""

    def run(table: pa.Table) -> pa.Table:
        heads = [np.frombuffer(t, np.uint32) for t in table.column("tokens").to_pylist()]
        n = np.array([h[0] for h in heads], np.int64)
        vectors = [np.unique(h[1:]) for h in heads]
        lost = np.array([len(h) - 1 - len(v) for h, v in zip(heads, vectors, strict=True)])
        least = np.minimum(n[:, None], n[None, :])
        may = _overlaps(vectors) >= _guaranteed(least, percent) - lost[:, None] - lost[None, :]
        may &= (100 * least >= percent * np.maximum(n[:, None], n[None, :])) & _counted_here(table)
        return table.select(["head", "x", "y", "block", "row", "heads"]).filter(pa.array(may.any(axis=1)))

    return run


def _group_links(percent: int, listed: bool):
    """All links of a block pair's rows: listed with their overlaps, or counted for each row with links that span their components."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.column("row").to_numpy()
        sets = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
        n = np.array([len(t) for t in sets], np.int64)
        overlap = _overlaps(sets)
        linked = (100 * overlap >= percent * (n[:, None] + n[None, :] - overlap)) & _counted_here(table)
        if listed:
            i, j = np.nonzero(np.triu(linked))
            return pa.table({"a": rows[i], "b": rows[j], "many": overlap[i, j].astype(np.int64)})
        a, b, left = [], [], np.ones(len(rows), bool)
        for seed in range(len(rows)):
            if not left[seed]:
                continue
            left[seed], queue = False, [seed]
            while queue:
                i = queue.pop()
                new = np.flatnonzero(linked[i] & left)
                left[new] = False
                a += [rows[i]] * len(new)
                b += rows[new].tolist()
                queue += new.tolist()
        counts = linked.sum(axis=1)
        some = np.flatnonzero(counts)
        return pa.table({"a": pa.array(a + rows[some].tolist(), pa.int64()), "b": pa.array(b + [None] * len(some), pa.int64()), "many": pa.array([None] * len(a) + counts[some].tolist(), pa.int64())})

    return run


def _rows_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("row"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _class_key(text: Column) -> Column:
    """What tells texts with words apart; null for the others."""
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(text)))


class _Candidates:
    """What both the components and the links start from.

    rows: a row per document; member: (head, row, n), who met in long lists; heads: short vectors; pairs: (a, b) that
    may link, each once; vectors: sets of wanted rows.
    """

    def __init__(self, docs: DataFrame, width: int, percent: int):
        spark = docs.sparkSession
        bounded_batches(spark)
        text = F.col("text").cast("string")
        docs = text_frame(docs).select(F.col("doc_id").cast("long").alias("doc_id"), _class_key(text).alias("content"), text.alias("text"))
        self.first = stash(_rows_and_counts(docs, width, percent), "ngram-rows")
        self.rows = self.first.where("column IS NULL").select("doc_id", "content", "n", "row", "row2")
        counted = self.first.where("column IS NOT NULL").groupBy("column").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= FREQUENT).orderBy(F.desc("seen"), "column").limit(TOP_COLUMNS).toArrow()
        columns = counted.column("column").to_numpy().view(np.uint64)
        order = np.argsort(columns)
        self.frequent = spark.sparkContext.broadcast((columns[order], counted.column("seen").to_numpy()[order]))
        self.vectors = lambda of, head: _vectors(docs, of, self.frequent, width, percent, head)

        shingles = self.rows.agg(F.sum("n")).first()[0] or 0
        blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(shingles * (100 - percent) / 100) // BLOCK_ROWS), 1)
        blocked = _entries(docs, self.frequent, width, percent).repartition(blocks, F.when(F.col("frequent"), F.col("row")).otherwise(F.col("column")))
        found = stash(blocked.mapInArrow(_block_product(percent, SHORT_LIST), "kind int, x long, y long, n int, m int"), "ngram-blocks")

        often = found.where(F.col("kind") == FREQUENT_ENTRY)
        top = often.groupBy("x").agg(F.max(F.struct("m", "y", "n")).alias("top"))  # TOP_COLUMNS rows at most
        often = often.select("x", "y", "n").join(F.broadcast(top), "x").select(F.col("top.y").alias("head"), F.col("y").alias("row"), "n", F.col("top.n").alias("of"))
        listed = found.where(F.col("kind") == MEMBER).select(F.col("x").alias("head"), F.col("y").alias("row"), "n", F.col("m").alias("of"))
        self.member = stash(listed.union(often).distinct(), "ngram-members")
        near = 100 * F.least("n", "of").cast("long") >= percent * F.greatest("n", "of").cast("long")
        star = self.member.where(near).select(F.col("head").alias("a"), F.col("row").alias("b"))
        met = stash(_ordered(found.where(F.col("kind") == PAIR).select(F.col("x").alias("a"), F.col("y").alias("b")).union(star)), "ngram-met")
        self.heads = self.vectors(_rows_of(met).union(self.member.select("row")), True)
        self.pairs = stash(_compare(met, self.heads, percent, True).select("a", "b"), "ngram-pairs")
        release(found, met)

    def in_blocks(self, placed: DataFrame) -> DataFrame:
        """placed, rows (head, row, n, ...) of groups, with `block`, and once for each two blocks x <= y that it is in."""
        groups = placed.groupBy("head").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("entries")).where("size > 1")
        blocks_of = F.ceil(F.greatest(F.col("size") / GROUP_ROWS, F.col("entries") / GROUP_ENTRIES)).cast("int")
        placed = placed.join(groups.select("head", blocks_of.alias("blocks")), "head").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
        meeting = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return meeting.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("other", "blocks", "n")

    def done(self) -> None:
        """Delete all but the rows."""
        release(self.member, self.heads, self.pairs)
        self.frequent.unpersist()


def _named(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(row, row2, least, component, component_id) of each distinct set: its least doc_id and its component."""
    classes = rows.where("n > 0").groupBy("row", "row2").agg(F.min("doc_id").alias("least"))
    named = classes.join(parts.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    return named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component")


def _links(docs: DataFrame, width: int, percent: int, listed: bool):
    """(rows, links): a row per document, and every link between distinct sets once.

    Links are (a, b, many) with the overlap as many if listed; else single rows (a, null, many) carry numbers
    of links, to be summed, and the others span the components. A link is counted by the pair that a short list
    gave, or, if long lists gather both rows, in the group of the least head that gathers both.
    """
    from_lists = _Candidates(docs, width, percent)
    gathered = stash(from_lists.member.groupBy("row").agg(F.collect_set("head").alias("heads")), "ngram-heads")
    of = lambda c: gathered.select(F.col("row").alias(c), F.col("heads").alias(f"h{c}"))
    single = from_lists.pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(~F.coalesce(F.arrays_overlap("ha", "hb"), F.lit(False)))
    single = stash(single.select("a", "b"), "ngram-single")
    sets = from_lists.vectors(_rows_of(single), False)
    links = stash(_compare(single, sets, percent, False).select("a", "b", F.col("overlap").alias("many")), "ngram-links")
    release(single, sets)
    found = links
    if not listed:
        ends = _rows_of(links).groupBy(F.col("row").alias("a")).agg(F.count(F.lit(1)).alias("many"))
        found = links.select("a", "b", F.lit(None).cast("long").alias("many")).union(ends.select("a", F.lit(None).cast("long"), "many"))

    meeting = stash(from_lists.in_blocks(from_lists.member.select("head", "row", "n")), "ngram-groups")
    live = meeting.join(from_lists.heads, "row").join(gathered, "row").groupBy("head", "x", "y").applyInArrow(_group_candidates(percent), "head long, x int, y int, block int, row long, heads array<long>")
    live = stash(live, "ngram-live")
    sets = from_lists.vectors(live.select("row"), False)
    grouped = live.join(sets, "row").groupBy("head", "x", "y").applyInArrow(_group_links(percent, listed), "a long, b long, many long")
    out = stash(found.union(grouped), "ngram-all-links")
    release(links, gathered, meeting, live, sets)
    from_lists.done()
    return from_lists.rows, out


def jaccard_links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, n_links) for every row of docs.

    A class are the documents of one set, named by its least doc_id; n_links is the number
    of other classes that its set links to. Documents without words are classes of their own.
    """
    rows, found = _links(docs, width, percent, False)
    named = _named(rows, components(found.where("b IS NOT NULL").select("a", "b")))
    many = found.where("b IS NULL").groupBy(F.col("a").alias("row")).agg(F.sum("many").alias("n_links"))
    ids = named.select("row", "row2", "least", "component_id").join(many, "row", "left")
    own = lambda c: F.when(F.col("n") > 0, F.col(c)).otherwise(F.col("doc_id"))
    return rows.join(ids, ["row", "row2"], "left").select("doc_id", F.col("n").alias("n_shingles"), own("least").alias("class_id"), own("component_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def link_pairs(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_a, doc_b, overlap) of every two classes whose sets link, each class by its least doc_id, a the lesser."""
    rows, found = _links(docs, width, percent, True)
    least = rows.where("n > 0").groupBy("row").agg(F.min("doc_id").alias("least"))
    pairs = found.join(least.select(F.col("row").alias("a"), F.col("least").alias("da")), "a").join(least.select(F.col("row").alias("b"), F.col("least").alias("db")), "b")
    turned = F.coalesce(F.col("da") > F.col("db"), F.col("da").isNull())
    return pairs.select(F.when(turned, F.col("db")).otherwise(F.col("da")).alias("doc_a"), F.when(turned, F.col("da")).otherwise(F.col("db")).alias("doc_b"), F.col("many").alias("overlap"))


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    return _placed(docs, width, percent).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _placed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(row, row2, doc_id, content, n, component, component_id) for every row of docs; the last two null where its set is empty."""
    from_lists = _Candidates(docs, width, percent)
    sets = from_lists.vectors(_rows_of(from_lists.pairs), False)
    links = stash(_compare(from_lists.pairs, sets, percent, False).select("a", "b"), "ngram-links")
    release(sets)
    parts = components(links)

    # rows that met in long lists: all that a typical row gathers, where they aren't one component yet
    placed = from_lists.member.select("head", "row", "n").join(parts.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    placed = stash(placed, "ngram-placed")
    mixed = placed.groupBy("head").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("head")
    meeting = from_lists.in_blocks(placed.join(mixed, "head", "left_semi"))
    live = meeting.join(from_lists.heads, "row").groupBy("head", "x", "y").applyInArrow(_group_live(percent), "head long, x int, y int, row long")
    live = stash(live, "ngram-live")
    if live.take(1):
        sets = from_lists.vectors(live.select("row"), False)
        forests = stash(live.join(sets, "row").groupBy("head", "x", "y").applyInArrow(_group_forest(percent), "a long, b long"), "ngram-forests")
        if forests.take(1):
            parts = components(links.union(_ordered(forests)))
        release(sets, forests)
    release(links, placed, live)
    from_lists.done()
    return from_lists.rows.join(_named(from_lists.rows, parts).select("row", "row2", "component", "component_id"), ["row", "row2"], "left")


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the least doc_id, and those without words; the same columns.

    Rows without a doc_id stay only where their component has no other; then one of them does. Rows of one doc_id
    count as one document only where their texts are in one component, or both without words; of texts that differ
    there the one with the least digest stays. Rows with neither a doc_id nor words all stay.
    """
    found = _placed(docs, width, percent)
    classes = found.groupBy("component", "doc_id", "content").agg(F.count(F.lit(1)).alias("copies"))
    classes = stash(classes.where("component IS NOT NULL OR doc_id IS NOT NULL"), "ngram-classes")
    first = classes.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content", "copies")).alias("k"))
    name = lambda i, c: F.unhex(F.md5(F.concat_ws(" ", F.coalesce(i.cast("string"), F.lit("none")), F.coalesce(F.hex(c), F.lit("none")))))
    kept = first.select("k.*").union(classes.where("component IS NULL").selectExpr("false", "doc_id", "content", "copies"))
    kept = stash(kept.select(name(F.col("doc_id"), F.col("content")).alias(f"{OWN}name"), "copies"), "ngram-kept")
    release(classes)

    content = _class_key(F.col("text").cast("string"))
    marked = docs.withColumn(f"{OWN}name", name(F.col("doc_id").cast("long"), content))
    nameless = F.col("doc_id").isNull() & content.isNull()
    out = marked.where(~nameless).join(kept, f"{OWN}name", "left_semi")
    if kept.where("copies > 1").take(1):
        out = out.dropDuplicates([f"{OWN}name"])
    rest = marked.where(nameless)
    return out.select(*(out[c] for c in (f"`{c}`" for c in rest.columns))).union(rest).drop(f"{OWN}name")


def digest(docs: DataFrame) -> DataFrame:
    return jaccard_links(docs)


ORACLE_SQL = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[a:a + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS a FROM (SELECT *, least(4, len(w)) AS k FROM word WHERE len(w) > 0))
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), overlap AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), link AS (
  SELECT a, b FROM overlap JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)
), both_ways AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b
)
, class AS (
  SELECT w.doc_id, least(w.doc_id, coalesce(min(other), w.doc_id)) AS class_id
  FROM word w LEFT JOIN (SELECT a AS doc_id, b AS other FROM overlap JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE k = p.n AND k = q.n UNION ALL
    SELECT b, a FROM overlap JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE k = p.n AND k = q.n) USING (doc_id) GROUP BY w.doc_id
), linked AS (
  SELECT x.doc_id, count(DISTINCT y.class_id) AS n_links FROM both_ways e JOIN class x ON x.doc_id = e.a JOIN class y ON y.doc_id = e.b WHERE x.class_id <> y.class_id GROUP BY x.doc_id
)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, class_id, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, coalesce(n_links, 0) AS n_links
FROM word w JOIN class USING (doc_id) LEFT JOIN size USING (doc_id) LEFT JOIN linked USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
"""
