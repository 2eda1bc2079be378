"""Secret scan: fixed patterns, and a battery of randomness tests on everything else that looks like a token.

A candidate is a run of 20 or more of the base64, hex or identifier signs; an equals sign with more behind it is no padding and parts two
candidates, as in ``NAME=value``. The smallest encoding that holds it (digits, hex, base32,
letters of one case with digits, letters and digits, base64) is its alphabet, and against it three tests are made: chi-squared
uniformity of its signs, runs above and below the middle of the alphabet, and serial correlation of neighbours. Fisher's method makes
one p-value of the three, the battery's. A candidate that it refuses at 0.001 isn't random.

A token may stand in a path or behind a prefix. Where no alphabet holds a candidate, or the battery refuses it, its parts between
``- _``, between ``+ /`` and between all four are candidates too; else those of its parts are whose alphabet is a one-case one (36 signs
at most) while the whole's isn't. Parts are reported where nothing above them is, and every candidate that was tried counts in the control below.

False discoveries are pieces of plain text. The likelihood ratio of uniform signs to the sign frequencies of text grows with the length
of a string; times the battery's p-value, which is one at most, its mean under text is still one at most (an e-value), so by Markov's
inequality the inverse of that product bounds the p-value of text. Among a document's candidates, Benjamini-Hochberg at rate 0.01 on
those bounds decides which are reported (kind: random): a short string must look more random than a long one.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.batches import emit, slices
from ontoloom.llm.pii import digest

BASE = ("assign", "access", "hex")
# The base patterns, and signs of text by falling frequency.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
BY_FREQUENCY = "etaoinshrdlcumwfgypbvkjxqz"
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PIECE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
PARTS = tuple(re.compile(f"[A-Za-z0-9{more}]{{20,}}") for more in ("+/", "_-", ""))
ONE_CASE = 36
LEAST_LENGTH, ASSIGN_LENGTH, ACCESS_LENGTH = 20, 8, 16
REFUSE, FALSE_RATE = 1e-3, 0.01
ALPHABETS = (
    string.digits,
    string.digits + "abcdef",
    string.digits + "ABCDEF",
    string.ascii_lowercase + "234567",
    string.ascii_uppercase + "234567",
    string.digits + string.ascii_lowercase,
    string.digits + string.ascii_uppercase,
    string.digits + string.ascii_uppercase + string.ascii_lowercase,
    string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/",
    string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_",
)


def _text_model() -> dict[str, float]:
    """Sign probabilities of running text: letters by a power of their rank, a tenth as often in capitals, other signs rare."""
    weight = {c: 1 / (3 + k) for k, c in enumerate(BY_FREQUENCY)}
    weight |= {c.upper(): w / 10 for c, w in list(weight.items())}
    weight |= dict.fromkeys(string.digits + "+/_=-", 0.01)
    total = sum(weight.values())
    return {c: w / total for c, w in weight.items()}


TEXT = _text_model()


def normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared_p(word: str, alphabet: str) -> float:
    """Wilson-Hilferty tail of the uniformity statistic; too even is as suspect as too uneven."""
    n, k, counts = len(word), len(alphabet), Counter(word)
    x = sum(c * c for c in counts.values()) * k / n - n
    # with few signs for each cell the statistic's mean is k - 1 and its variance 2 (k - 1) (1 - 1/n)
    free = k - 1
    z = (x - free) / math.sqrt(2 * free * (1 - 1 / n))
    if n >= 5 * k:
        z = ((x / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)) if x > 0 else -9.0
    return normal_tail(z)


def runs_p(values: list[int], k: int) -> float:
    high = [v * 2 >= k for v in values]
    n, a = len(high), sum(high)
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    mean = 1 + 2 * a * b / n
    spread = (mean - 1) * (mean - 2) / (n - 1)
    return normal_tail((runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0


def serial_p(values: list[int]) -> float:
    n, mean = len(values), sum(values) / len(values)
    dev = [v - mean for v in values]
    power = sum(d * d for d in dev)
    if not power:
        return 2.0 ** (1 - n)
    r = sum(x * y for x, y in zip(dev, dev[1:], strict=False)) / power
    return normal_tail((r + 1 / n) * math.sqrt(n))


def fisher(p: list[float]) -> float:
    """One p-value of three independent ones: the tail of a chi-squared variable of six degrees of freedom."""
    if min(p) <= 0:
        return 0.0
    s = -sum(map(math.log, p))
    return min(1.0, math.exp(-s) * (1 + s + s * s / 2))


def battery_p(word: str, alphabet: str) -> float:
    """The three tests' p-value of ``word`` as uniform signs of ``alphabet``."""
    values = [alphabet.index(c) for c in word]
    return fisher([chi_squared_p(word, alphabet), runs_p(values, len(alphabet)), serial_p(values)])


def encoding(word: str) -> str | None:
    """The smallest alphabet that holds a word, the first of equal ones."""
    return next((a for a in ALPHABETS if set(word) <= set(a)), None)


def text_p(word: str) -> float | None:
    """Bound of the p-value under plain text, or None where the battery refuses randomness."""
    alphabet = encoding(word)
    if alphabet is None or (battery := battery_p(word, alphabet)) < REFUSE:
        return None
    bits = sum(-math.log2(len(alphabet)) - math.log2(TEXT[c]) for c in word)
    # the encoding was chosen by looking: the bound is multiplied by the number of choices
    return min(1.0, len(ALPHABETS) * 2.0**-bits / battery)


def candidates(text: str) -> list[tuple[int, int, float | None, int]]:
    """(start, end, bound or None, level) of everything tried: a whole has level 0, its parts 1 or 2."""
    out = []
    for run in CANDIDATE.finditer(text):
        for m in PIECE.finditer(text, run.start(), run.end()):
            bound, alphabet, tried = text_p(m[0]), encoding(m[0]), {m.span()}
            out.append((*m.span(), bound, 0))
            for kind in PARTS if bound is None else PARTS[2:]:
                for part in kind.finditer(text, *m.span()):
                    if part.span() not in tried and (bound is None or len(encoding(part[0])) <= ONE_CASE < len(alphabet)):
                        tried.add(part.span())
                        out.append((*part.span(), text_p(part[0]), 2 if kind is PARTS[2] else 1))
    return out


def apart(spans: list[tuple[int, int, float, int]]) -> list[tuple[int, int]]:
    """Spans by level, then bound, less those that overlap an earlier one."""
    kept: list[tuple[int, int]] = []
    for a, b, *_ in sorted(spans, key=lambda s: (s[3], s[2], s[0])):
        k = bisect_left(kept, (a, b))
        if (k == 0 or kept[k - 1][1] <= a) and (k == len(kept) or kept[k][0] >= b):
            kept.insert(k, (a, b))
    return kept


def accepted(p: list[float], tests: int, rate: float = FALSE_RATE) -> float:
    """Benjamini-Hochberg: the largest p-value that is reported, or -1."""
    best = -1.0
    for k, x in enumerate(sorted(p), 1):
        if x <= rate * k / tests:
            best = x
    return best


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind (assign, access, hex, random). Ends are exclusive, in code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if tried := candidates(text):
        limit = accepted([p for _, _, p, _ in tried if p is not None], len(tried))
        found += [(a, 3, b) for a, b in apart([t for t in tried if t[2] is not None and t[2] <= limit])]
    return [((*BASE, "random")[k], a, b) for a, k, b in sorted(found)]


_ROW = pa.schema([("doc_id", pa.int64())] + [(f"n_{k}", pa.int64()) for k in BASE] + [("base_sha256", pa.string()), ("spans", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        out: dict[str, list] = {n: [] for n in _ROW.names}
        for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            found = spans(text or "")
            base = [s for s in found if s[0] in BASE]
            out["doc_id"].append(doc_id)
            for kind in BASE:
                out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(digest(base).encode()).hexdigest())
            out["spans"].append(digest(found))
        yield emit(_ROW, **out)


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row, of whole texts.

    A null text is empty and has no spans. Rows stand alone, so ties, repeats and empty tables need nothing special. The
    family of the false-discovery control is the document, so a row's result depends on no other row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
