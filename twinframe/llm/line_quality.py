"""Quality rules: a linear-chain conditional random field over a document's lines.

Every line that has a word is a site with two labels, boilerplate (0) and content (1).
The field scores content by a weighted sum of line features and neighbouring labels by
a transition table; Viterbi decoding gives the best labelling of the whole sequence.
A document stays if the share of its words in content lines reaches `min_share` and
the base rules (enough words, not mostly repeated three-word windows) hold.

The weights below were fitted by `fit` on lines of labelled documents, each line
labelled as its document is. The features describe form, not vocabulary.

Scale: one pass, no shuffle; a document's state is a few counters and two back
pointers per line.

Defined cases: a null or empty text has no words, fails the base rules and goes;
ties in decoding go to content; repeated rows are judged alike, each for itself;
an empty table gives an empty table; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OWN, append_columns, text_frame

MIN_WORDS, MAX_REPEAT_PERCENT, MIN_SHARE = 50, 50, 0.5

_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_UNCOUNTED = bytes([*_SPACE, *range(0x80, 0xC0)])  # white space and UTF-8 continuation bytes
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_LETTER = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128))
_NOT_DIGIT = bytes(c for c in range(256) if not 48 <= c <= 57)
_END = (b".", b"?", b"!", b'"', b":", b";", b"\xe2\x80\xa6", b"\xe3\x80\x82")

_SEPARATORS = (b"|", b"\xc2\xb7", b">", b"\xc2\xbb", b"/", b"-")

FEATURES = ("bias", "words", "symbols", "capitals", "shouts", "digits", "repeated", "sentence", "short", "separators")


def line_features(line: bytes, words: list[bytes], repeated: bool) -> tuple[float, ...]:
    """Form of one line: each value lies between 0 and 1."""
    n = len(words)
    letters = len(line.translate(None, _NOT_LETTER))
    symbols = len(line) - len(line.translate(None, _SYMBOLS))
    return (
        1.0,
        min(n, 20) / 20,
        min(symbols / n, 1.0),
        max(0, len(line.translate(None, _NOT_UPPER)) - n) / letters if letters else 0.0,  # beyond one a word
        min((line.count(b"!!") + line.count(b"??")) / n, 1.0),
        min(len(line.translate(None, _NOT_DIGIT)) / (letters + 1), 1.0),
        float(repeated),
        float(words[-1].endswith(_END)),
        float(n < 4),
        min(2 * sum(words.count(x) for x in _SEPARATORS) / n, 1.0),
    )


@dataclass(frozen=True)
class LineField:
    """Weights of the features for content, and scores of label pairs (before, after)."""

    weights: tuple[float, ...] = (0.22, 0.78, -7.0, -5.99, -4.0, -1.5, -1.35, 0.75, -0.46, -4.0)
    moves: tuple[tuple[float, float], tuple[float, float]] = ((1.01, -0.84), (-0.96, 0.78))

    def unary(self, features) -> list[float]:
        return [sum(w * x for w, x in zip(self.weights, f, strict=True)) for f in features]

    def decode(self, unary: list[float]) -> list[int]:
        """The labelling with the highest score, by Viterbi."""
        if not unary:
            return []
        (stay0, to1), (to0, stay1) = self.moves
        zero, one, back = 0.0, unary[0], []
        for u in unary[1:]:
            a, b, c, d = zero + stay0, one + to0, zero + to1, one + stay1
            back.append((b >= a, d >= c))
            zero, one = max(a, b), max(c, d) + u
        label = int(one >= zero)
        out = [label]
        for pair in reversed(back):
            label = int(pair[label])
            out.append(label)
        return out[::-1]


PRIOR = LineField((0.6, 0.9, -7.0, -6.0, -4.0, -1.5, -1.2, 0.8, -0.3, -4.0), ((0.5, -0.5), (-0.5, 0.5)))


def fit(sequences: list[list[tuple[float, ...]]], labels: list[list[int]], steps: int = 120, rate: float = 0.05, penalty: float = 0.02) -> LineField:
    """Maximum a posteriori by gradient ascent, under a Gaussian prior around PRIOR; expectations by forward-backward."""
    w, m = np.array(PRIOR.weights), np.array(PRIOR.moves)
    w0, m0 = w.copy(), m.copy()
    moments = [np.zeros_like(w), np.zeros_like(m), np.zeros_like(w), np.zeros_like(m)]
    data = [(np.array(s), np.array(y)) for s, y in zip(sequences, labels, strict=True) if s]
    sites = sum(len(y) for _, y in data)
    for step in range(1, steps + 1):
        gw, gm = -penalty * (w - w0) * sites, -penalty * (m - m0) * sites
        for x, y in data:
            score = np.stack([np.zeros(len(y)), x @ w], axis=1)
            fwd, bwd = np.zeros_like(score), np.zeros_like(score)
            fwd[0] = score[0]
            for i in range(1, len(y)):
                fwd[i] = score[i] + np.logaddexp(*(fwd[i - 1][:, None] + m))
            for i in range(len(y) - 2, -1, -1):
                bwd[i] = np.logaddexp(*(m + score[i + 1] + bwd[i + 1]).T)
            total = np.logaddexp(*fwd[-1])
            gw += x.T @ (y - np.exp(fwd[:, 1] + bwd[:, 1] - total))
            for i in range(1, len(y)):
                gm -= np.exp(fwd[i - 1][:, None] + m + score[i] + bwd[i] - total)
                gm[y[i - 1], y[i]] += 1
        for k, (value, g) in enumerate(((w, gw / sites), (m, gm / sites))):
            moments[k] = 0.9 * moments[k] + 0.1 * g
            moments[k + 2] = 0.999 * moments[k + 2] + 0.001 * g * g
            value += rate * (moments[k] / (1 - 0.9**step)) / (np.sqrt(moments[k + 2] / (1 - 0.999**step)) + 1e-8)
    return LineField(tuple(map(float, w)), tuple(tuple(map(float, r)) for r in m))


@dataclass(frozen=True)
class Measured:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    content_words: int


def site_features(text: bytes) -> tuple[list[tuple[float, ...]], list[int], int]:
    """Features and words of each line that has a word, and how many equal an earlier line."""
    features, sizes, seen, dup = [], [], set(), 0
    for line in text.split(b"\n"):
        if words := line.split():
            again = line in seen
            dup += again
            seen.add(line)
            features.append(line_features(line, words, again))
            sizes.append(len(words))
    return features, sizes, dup


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(counts := Counter(windows)) == len(windows):
        return 0
    total, upto = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def measure(text: bytes, crf: LineField) -> Measured:
    words = text.split()
    features, sizes, dup = site_features(text)
    content = sum(n for n, label in zip(sizes, crf.decode(crf.unary(features)), strict=True) if label)
    return Measured(len(words), len(text.translate(None, _UNCOUNTED)), len(text) - len(text.translate(None, _SYMBOLS)), dup, repeat_words(words), content)


def judge(docs: DataFrame, crf: LineField | None = None, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, min_share: float = MIN_SHARE) -> DataFrame:
    """docs with `__tf_` columns: the counts of Measured, base_failed and kept."""
    crf = crf or LineField()
    names = list(Measured.__dataclass_fields__)

    def make():
        def compute(texts):
            got = [measure(t or b"", crf) for t in texts]
            return [[getattr(m, n) for m in got] for n in names]

        return compute

    measured = append_columns(docs, "text", [T.StructField(OWN + n, T.LongType()) for n in names], make)
    n, repeat = F.col(f"{OWN}n_words"), F.col(f"{OWN}n_repeat_words")
    failed = (n < min_words) | (100 * repeat > max_repeat_percent * n)
    return measured.withColumn(f"{OWN}base_failed", failed).withColumn(f"{OWN}kept", ~failed & (F.col(f"{OWN}content_words") >= min_share * n))


def keep_good(docs: DataFrame, **rules) -> DataFrame:
    """The documents that pass, with their columns as they were."""
    return judge(docs, **rules).where(f"{OWN}kept").select(*(F.col(f"`{c}`") for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words")
    return judge(text_frame(docs)).select("doc_id", *(F.col(OWN + n).alias(n) for n in names))
