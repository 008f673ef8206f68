"""Benchmark decontamination by a generalised suffix automaton.

All test items, normalised to words, go into one suffix automaton. Each document
streams its words through it; at every word the automaton gives the longest suffix
read so far that occurs in some item. Where that length reaches the window, the last
`window` words are a window of an item; which items have it is stored at the state
that holds the window. Items shorter than the window count as one window each.

Scale: a benchmark of up to CHUNK_WORDS words is one automaton, and documents are never shuffled.
A larger one is dealt into parts of about so many words, whose words are counted before they are
fetched. The parts are scanned one after the other, each with a pass over the texts: one automaton
is alive at a time, on the driver and in the workers. Hits are written out by the text's digest,
once for equal texts, and meet the documents in one join. Results are those of one automaton.

Defined cases: a null or empty text has no words and no hits; null or empty items
have no windows; equal items and repeated item ids count once per id; repeated
documents are scanned each for itself; an empty benchmark leaves all documents clean;
other columns, whatever their names, pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OWN, append_columns, bounded_batches, lean, stash, text_frame

WINDOW = 13
#: Share of a document's words above which the whole document goes.
MAX_COVERAGE = 0.05
#: Words in one automaton, and so in one broadcast, at most (about 100 MB).
CHUNK_WORDS = 200_000

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z went to lower case."""
    return text.translate(_KEEP).split()


class SuffixAutomaton:
    """Generalised suffix automaton of token sequences."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items_at: dict[int, set[str]] = {}  # state -> items whose window of full length ends there
        self.short_at: dict[int, dict[int, set[str]]] = {}  # state -> length of a short item -> items

    def _state(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, token: bytes) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, token: bytes) -> int:
        q = self.next[last].get(token)
        if q is not None:  # an earlier item has this prefix
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return new

    def insert(self, tokens: list[bytes]) -> None:
        last = 0
        for token in tokens:
            last = self._extend(last, token)

    def mark(self, item: str, tokens: list[bytes]) -> None:
        """Store the item at the states of its windows; after all items are in."""
        state = 0
        for i, token in enumerate(tokens):
            state = self.next[state][token]
            while self.length[self.link[state]] >= self.window:
                state = self.link[state]
            if i + 1 >= self.window:
                self.items_at.setdefault(state, set()).add(item)
        if 0 < len(tokens) < self.window:
            self.short_at.setdefault(state, {}).setdefault(len(tokens), set()).add(item)

    def finish(self) -> None:
        """For each state: the state of its suffix of window length, and the short items among its suffixes."""
        n = len(self.next)
        self.full, self.shorts = [0] * n, [()] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[s] >= self.window:
                self.full[s] = self.full[up] if self.length[up] >= self.window else s
            self.shorts[s] = (*self.shorts[up], *sorted((k, tuple(sorted(v))) for k, v in self.short_at.get(s, {}).items()))
        self.plain = not self.short_at

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Hit word ranges, merged and in order, and the items that have windows in words."""
        moves, link, length, full, shorts, window = self.next, self.link, self.length, self.full, self.shorts, self.window
        spans: list[list[int]] = []
        items: set[str] = set()
        seen: set[int] = set()
        state = matched = 0
        root = moves[0]
        for i, word in enumerate(words):
            to = moves[state].get(word)
            if to is not None:
                state = to
                matched += 1
            elif word not in root:
                state = matched = 0
                continue
            else:
                state = link[state]
                while word not in moves[state]:
                    state = link[state]
                matched = length[state] + 1
                state = moves[state][word]
            if matched >= window:
                at = full[state]
                if at not in seen:
                    seen.add(at)
                    items |= self.items_at[at]
                _cover(spans, i + 1 - window, i + 1)
            if shorts[state]:
                for n, who in shorts[state]:
                    if n <= matched:
                        items.update(who)
                        _cover(spans, i + 1 - n, i + 1)
        return spans, items


def _cover(spans: list[list[int]], start: int, end: int) -> None:
    """Add a range that ends at or after all others."""
    while spans and spans[-1][1] >= start:
        start = min(start, spans.pop()[0])
    spans.append([start, end])


def build(items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW) -> SuffixAutomaton:
    items = [(k, w) for k, w in items if w]
    automaton = SuffixAutomaton(window)
    for _, tokens in items:
        automaton.insert(tokens)
    for item, tokens in items:
        automaton.mark(item, tokens)
    automaton.finish()
    return automaton


def _parted(benchmark: DataFrame, chunk_words: int) -> tuple[DataFrame, int]:
    """The items, and into how many parts they are dealt; words are counted before any text is fetched."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = F.floor(F.length("text") / 2) + 1  # no text has more words
    return items, max(1, -(-(items.agg(F.sum(size)).first()[0] or 0) // chunk_words))


def _shipped(items: DataFrame, parts: int, k: int, window: int):
    """The automaton of the items of part k, as a broadcast."""
    part = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
    return items.sparkSession.sparkContext.broadcast(build(((r.item, plain_words(r.text.encode())) for r in part.toLocalIterator()), window))


_SPANS, _ITEMS = T.ArrayType(T.ArrayType(T.LongType())), T.ArrayType(T.StringType())


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """docs with `__tf_n_words`, `__tf_spans` (hit word ranges, end exclusive) and `__tf_items` (ids as strings)."""
    items, parts = _parted(benchmark, chunk_words)
    if parts > 1:
        return _scan_by_parts(docs, items, parts, window)
    shipped = _shipped(items, 1, 0, window)

    def make():
        automaton = shipped.value

        def compute(texts):
            words = [plain_words(text or b"") for text in texts]
            found = [automaton.scan(w) for w in words]
            return [[len(w) for w in words], [spans for spans, _ in found], [sorted(who) for _, who in found]]

        return compute

    return append_columns(docs, "text", [T.StructField(f"{OWN}n_words", T.LongType()), T.StructField(f"{OWN}spans", _SPANS), T.StructField(f"{OWN}items", _ITEMS)], make)


def _scan_by_parts(docs: DataFrame, items: DataFrame, parts: int, window: int) -> DataFrame:
    """The same for a benchmark of several parts: one automaton at a time, whose hits are written out by the text's digest."""
    content, spans, who = f"{OWN}content", f"{OWN}spans", f"{OWN}items"
    text = F.col("text").cast("string")
    texts = docs.select(F.md5(text).alias(content), text.alias("text")).where("text IS NOT NULL")
    bounded_batches(docs.sparkSession)

    def hits_of(shipped):
        def run(batches):
            automaton = shipped.value
            for batch in batches:
                rows = []
                for digest, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                    found, ids = automaton.scan(plain_words(value))
                    if found:
                        rows.append((digest, found, sorted(ids)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())))], names=[content, spans, who])

        return lean(run)

    found = None
    for k in range(parts):
        shipped = _shipped(items, parts, k, window)
        hits = texts.mapInArrow(hits_of(shipped), T.StructType([T.StructField(content, T.StringType()), T.StructField(spans, _SPANS), T.StructField(who, _ITEMS)]))
        hits = stash(hits.groupBy(content).agg(F.first(spans).alias(spans), F.first(who).alias(who)), "benchmark-hits")
        shipped.destroy()
        found = hits if found is None else found.union(hits)
    merge = F.pandas_udf(_merged, _SPANS)
    found = found.groupBy(content).agg(F.flatten(F.collect_list(spans)).alias(spans), F.array_sort(F.array_distinct(F.flatten(F.collect_list(who)))).alias(who)).withColumn(spans, merge(spans))
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.withColumn(content, F.md5(text)).join(found, content, "left")
    none = lambda kind: F.from_json(F.lit("[]"), kind)
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), F.coalesce(F.regexp_count(lower, F.lit(_WORD.pattern)), F.lit(0)).cast("long").alias(f"{OWN}n_words"), F.coalesce(spans, none(_SPANS)).alias(spans), F.coalesce(who, none(_ITEMS)).alias(who))


def _merged(ranges):
    """Unions of overlapping or touching ranges, for passes over several chunks."""

    def one(value):
        out: list[list[int]] = []
        for start, end in sorted(map(list, value)):
            if out and out[-1][1] >= start:
                out[-1][1] = max(out[-1][1], end)
            else:
                out.append([int(start), int(end)])
        return out

    return ranges.map(one)


def n_hit() -> Column:
    return F.aggregate(f"{OWN}spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """docs without what they share with the benchmark; the same columns.

    Documents whose hit words make up max_coverage or more of all words go. From the
    others, hit spans are cut out of the text (from the first hit word to the end of
    the last); n_chars, if there is such a column, follows the new text.
    """
    hit = n_hit()
    found = scan(docs, benchmark, window).where((hit == 0) | (hit < F.col(f"{OWN}n_words") * max_coverage))
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    at, spans_at, keep = found.columns.index("text"), found.columns.index(f"{OWN}spans"), docs.columns
    counted = "n_chars" in keep

    def cut(batches):
        for batch in batches:
            spans = batch.column(spans_at).to_pylist()
            if any(spans):
                texts = batch.column(at).to_pylist()
                texts = [without(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
                batch = batch.set_column(at, "text", pa.array(texts, batch.column(at).type))
                if counted:
                    k = batch.schema.names.index("n_chars")
                    old = batch.column(k).to_pylist()
                    batch = batch.set_column(k, "n_chars", pa.array([len(t) if s else o for t, s, o in zip(texts, spans, old, strict=True)], batch.column(k).type))
            yield batch.select(keep)

    return found.mapInArrow(lean(cut), T.StructType([T.StructField(c, kinds[c]) for c in keep]))


def without(text: str, spans: list[list[int]]) -> str:
    """text without the given word ranges."""
    at = [m.span() for m in _WORD.finditer(text.translate({c: c + 32 for c in range(65, 91)}))]
    out, last = [], 0
    for start, end in spans:
        out.append(text[last : at[start][0]])
        last = at[end - 1][1]
    return "".join([*out, text[last:]])


def digest(docs: DataFrame, benchmark: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """One row per document: what it shares with the benchmark."""
    found = scan(text_frame(docs), benchmark, chunk_words=chunk_words)
    return found.select(
        "doc_id",
        F.col(f"{OWN}n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size(f"{OWN}items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{OWN}items", ","), 256).alias("items_sha256"),
        ((n_hit() > 0) & (20 * n_hit() >= F.col(f"{OWN}n_words"))).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH plain AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_window AS (
  SELECT DISTINCT item_id, k, array_to_string(w[a:a + k - 1], ' ') AS s
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS a FROM (SELECT *, least(13, len(w)) AS k FROM item WHERE len(w) > 0))
), doc_window AS (
  SELECT doc_id, a, k, array_to_string(w[a:a + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS a FROM plain, (SELECT DISTINCT k FROM item_window) WHERE len(w) >= k)
), found AS (
  SELECT d.doc_id, d.a, d.k, i.item_id FROM doc_window d JOIN item_window i ON i.k = d.k AND i.s = d.s
), hit AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, a + unnest(range(k)) AS p FROM found) GROUP BY doc_id
), who AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT p.doc_id, len(p.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(p.w) AS contaminated
FROM plain p LEFT JOIN hit USING (doc_id) LEFT JOIN who USING (doc_id)
"""
