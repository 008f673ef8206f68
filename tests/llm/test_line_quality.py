import itertools
import random
import re

from pyspark.sql import Row

from twinframe.llm import line_quality as q


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


TEXTS = [None, "", " \n\t\n", "a b a b a b", "É b c\x0bd\n" * 30, "one two three four. " * 3, "x\n x\nx\n\nx", "".join(chr(97 + i % 26) + " " for i in range(200)), "| a | b\r\n# *$", "word " * 3000]


def test_base_counts_like_brute_force(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice(["aa", "b", "É", " ", " ", "\n", "#", "\t"]) for _ in range(rng.randrange(400))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in q.digest(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(t), t
        assert not (r.base_failed and r.kept)


def test_viterbi_is_the_best_labelling():
    rng = random.Random(1)
    for _ in range(200):
        f = q.LineField(moves=tuple(tuple(rng.uniform(-2, 2) for _ in range(2)) for _ in range(2)))
        u = [rng.uniform(-2, 2) for _ in range(rng.randrange(1, 8))]
        score = lambda y: sum(a for a, b in zip(u, y) if b) + sum(f.moves[a][b] for a, b in zip(y, y[1:]))  # noqa: B023
        best = max(map(score, itertools.product((0, 1), repeat=len(u))))
        assert abs(score(f.decode(u)) - best) < 1e-9
    assert q.LineField().decode([]) == []


def test_fit_learns_the_separating_feature():
    good, bad = b"A plain sentence that reads well, as text does.", b"### $$$ *** %%% &&& ||| ### $$$"
    make = lambda line: q.line_features(line, line.split(), False)
    crf = q.fit([[make(good)] * 3, [make(bad)] * 3, [make(good), make(bad)]], [[1] * 3, [0] * 3, [1, 0]], steps=50)
    assert crf.decode(crf.unary([make(good), make(good), make(bad), make(bad)])) == [1, 1, 0, 0]


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    prose = "\n".join(" ".join(word() for _ in range(15)).capitalize() + "." for _ in range(6))
    junk = " ".join(w + rng.choice(["###", "***", "$$$"]) for w in prose.split())
    rows = [Row(doc_id=1, text=prose, kept="mine"), Row(doc_id=2, text=junk, kept="x"), Row(doc_id=3, text=" | ".join(prose.split()), kept="x"), Row(doc_id=4, text=None, kept=None), Row(doc_id=5, text=" ".join(w.upper() + "!!" for w in prose.split()), kept="x"), Row(doc_id=1, text=prose, kept="mine")]
    assert q.keep_good(spark.createDataFrame(rows)).collect() == [rows[0], rows[0]]
    assert q.keep_good(spark.createDataFrame(rows).limit(0)).columns == ["doc_id", "text", "kept"]


def test_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    got = q.digest(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed")
    assert got.where("kept and quality = 0").count() == 0 and got.where("not kept and quality = 1").count() == 0
