import base64
import hashlib
import math
import random
import re
from collections import Counter

from twinframe.llm import secrets as s

PATTERNS = (
    ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)


def brute(text):
    out = []
    for order, (kind, pattern, ok) in enumerate(PATTERNS):
        out += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text or "") if ok(m)]
    return sorted(out)


def test_base_spans_like_brute_force(spark):
    rng = random.Random(9)
    pieces = ["password", "Secret", "api_key", "APIKEY", "tokEn", ":", "=", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef0123", "0123456789abcdef01234567", "é", "𝔘", "x", "\n", "token:abcdef", "hunter2hunter2", "/+_.=-"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 40))) for _ in range(400)] + [None, "", 'secret: "token:abcdefg', "passwd=ab", "K=ſecret=abcdefgh", "plain words only", "é" * 500 + "0" * 24]
    docs = spark.createDataFrame([(i % 397, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").withColumn("row", s.F.monotonically_increasing_id())
    rows = {}
    for i, t in enumerate(texts):
        rows.setdefault(i % 397, []).append(brute(t))
    got = {}
    for r in s.digest(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for k, wanted in rows.items():
        sums = sorted((hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in w).encode()).hexdigest(), *(sum(x[3] == kind for x in w) for kind, *_ in PATTERNS)) for w in wanted)
        assert sorted((r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in got[k]) == sums
        for r in got[k]:
            base = [x for x in r.spans.split(",") if x and not x.startswith("random")]
            assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["the", "tion", "er", "an", "ing", "re", "on"]) for _ in range(3))
    plain = [f"{word()}_{word()}-{word()}-{rng.randrange(1, 99)}" for _ in range(60)] + ["aaaaaaaaaaaaaaaaaaaa1111111111", "2024-01-01-2024-01-02-2024", "abcabcabcabcabcabcabcabc123", "https/www/example/com/page/index/2"]
    secret = [base64.b64encode(bytes(rng.randrange(256) for _ in range(36))).decode() for _ in range(20)]
    docs = spark.createDataFrame([(i, f"{word()} {t} {word()}.") for i, t in enumerate(plain + secret)], "doc_id long, text string")
    found = {r.doc_id for r in s.digest(docs).collect() if "random" in r.spans}
    assert len([i for i in found if i >= len(plain)]) >= 17 and not [i for i in found if i < len(plain)]
    span = next(r for r in s.digest(docs).collect() if r.doc_id == max(found)).spans.split(":")
    text = docs.where(f"doc_id = {max(found)}").first().text
    assert text[int(span[1]) : int(span[2])].rstrip("=") in secret[-1] or max(found) != len(plain + secret) - 1
    assert s.digest(docs.limit(0)).count() == 0


def test_tail_of_the_normal_distribution(spark):
    from math import erfc, sqrt

    zs = [-3.0, -1.0, 0.0, 0.5, 2.0, 5.0, 9.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", s._above(s.F.col("z")).alias("p")).collect()
    assert all(abs(r.p / (erfc(r.z / sqrt(2)) / 2) - 1) < 0.05 for r in got)




def test_rejected_candidates_do_not_count_for_the_rate(spark):
    rng = random.Random(3)
    letters = s._UPPER + s._LOWER + s._DIGITS
    keys = ["".join(rng.sample(letters, 20)) for _ in range(6)]
    rejected = [f"zzzzzzzzzzzzzzzzzzzz{i}" for i in range(1000, 1600)]
    docs = spark.createDataFrame(list(enumerate(keys + rejected)), "doc_id long, text string")
    found = {r.doc_id for r in s.digest(docs).collect() if "random" in r.spans}
    assert len(found) >= 4 and max(found) < len(keys)


def test_keys_of_letters_only_are_found(spark):
    rng = random.Random(8)
    keys = ["".join(rng.choice(alphabet) for _ in range(60)) for alphabet in (s._UPPER + s._LOWER, s._UPPER, s._LOWER) for _ in range(8)]
    plain = ["-" * 40, "counterrevolutionaries", "getUserAccountInformation", "https/www/example/com/page/index/html", "well-known-state-of-the-art-method"]
    docs = spark.createDataFrame(list(enumerate(keys + plain)), "doc_id long, text string")
    found = {r.doc_id for r in s.digest(docs).collect() if "random" in r.spans}
    assert len(found) >= 20 and max(found) < len(keys)


def test_padding_alone_is_no_candidate(spark):
    docs = spark.createDataFrame([(1, "=" * 30), (2, "1" + "=" * 25), (3, "a" + "=" * 25)], "doc_id long, text string")
    assert [r.spans for r in s.digest(docs).collect()] == ["", "", ""]


def above(z):
    t = 1 / (1 + 0.2316419 * abs(z))
    tail = 0.3989422804014327 * math.exp(-z * z / 2) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return tail if z >= 0 else 1 - tail


def battery(token):
    """(least p of the three tests times three, p against ordinary text, length) of one candidate."""
    bare = token.rstrip("=")
    alphabet = next(letters for pattern, letters in s.ENCODINGS if re.search(pattern, bare))
    x, n, k = [alphabet.index(c) for c in bare], len(bare), len(alphabet)
    squares = sum(v * v for v in Counter(x).values())
    chi, free = k / n * squares - n, k - 1
    uniform = above(((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))
    high = [2 * v >= k for v in x]
    a, b = sum(high), n - sum(high)
    mean = 2 * a * b / n + 1
    runs = 1 + sum(p != q for p, q in zip(high, high[1:]))
    turns = 2 * above(abs((runs - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1)))) if a > 1 and b > 1 else 0.0
    middle = sum(x) / n
    spread = sum((v - middle) ** 2 for v in x)
    serial = 2 * above(abs(sum((p - middle) * (q - middle) for p, q in zip(x, x[1:])) / spread * math.sqrt(n))) if spread else 0.0
    pairs, ordinary = n * (n - 1), max(2 / k, 0.065)
    plain = above((ordinary - (squares - n) / pairs) / math.sqrt(2 * ordinary * (1 - ordinary) / pairs))
    return min(1.0, 3 * min(uniform, turns, serial)), plain, n


def brute_random(texts, rate=s.RATE):
    """Spans of the kind random in each text: the battery, then the rule of the false discovery rate by classes of lengths."""
    scored = []
    for i, t in enumerate(texts):
        base = brute(t)
        for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", t):
            if len(m[0].rstrip("=")) > 1 and not any(b < m.end() and m.start() < e for b, _, e, _ in base):
                random_p, plain, n = battery(m[0])
                if random_p >= s.ALPHA:
                    scored.append((sum(n >= least for least in s.LENGTHS[1:]), min(s.BINS - 1, math.floor(-10 * math.log10(max(plain, 1e-300)))), i, m.span()))
    out = [[] for _ in texts]
    for of in {x[0] for x in scored}:
        mine = sorted((x for x in scored if x[0] == of), key=lambda x: -x[1])
        good = [bin_ for _, bin_, *_ in mine if 10 ** (-bin_ / 10) <= rate * sum(y[1] >= bin_ for y in mine) / len(mine)]
        for _, bin_, i, span in mine:
            if good and bin_ >= min(good):
                out[i].append(span)
    return [sorted(x) for x in out]


def test_whole_battery_like_plain_python(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["the", "tion", "er", "an", "ing", "re", "on", "_", "-", "/", "42"]) for _ in range(rng.randrange(6, 14)))
    key = lambda: "".join(rng.choice(rng.choice(s.ENCODINGS)[1]) for _ in range(rng.randrange(18, 90)))
    same = lambda: "".join(rng.choices(rng.choice(s.ENCODINGS)[1], k=rng.randrange(18, 90)))
    texts = [" ".join(rng.choice([word, word, word, key, same])() for _ in range(rng.randrange(1, 9))) + rng.choice(["", "==", "."]) for _ in range(150)]
    got = {r.doc_id: r for r in s.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    wanted = brute_random(texts)
    assert sum(map(len, wanted)) > 50
    for i, spans in enumerate(wanted):
        assert [x for x in got[i].spans.split(",") if x.startswith("random")] == [f"random:{a}:{b}" for a, b in spans], texts[i]
