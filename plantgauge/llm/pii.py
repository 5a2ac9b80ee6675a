"""Personal data by weak supervision.

Patterns propose spans. Labelers (shape, checksum, context, gazetteer, bounds,
other use) vote for, against or abstain. Expectation-maximisation over the counts
of vote patterns estimates how reliable each labeler is, without any labels; the
resulting probabilities train a logistic span classifier, whose verdict adds
spans. The four base kinds are kept whatever it says.
"""

from __future__ import annotations

import bisect
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plantgauge.llm.common import in_arrow, keeps_names, whole_text

BASE = ["email", "ip", "card", "phone"]
ADDED = ["secret", "iban", "ssn", "local_phone", "person"]
KINDS = BASE + ADDED

# The patterns of the kinds.
LOCAL = "A-Za-z0-9._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{24,128}(?![A-Za-z0-9_-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])")
# The gazetteers and context words of the labelers.
NAMES = frozenset(
    "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth "
    "Barbara Susan Jessica Sarah Karen Pierre Jean Marie Claire Hans Klaus Ursula Carlos Juan Carmen".split()
)
PERSON = re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]+ [A-Z][a-z]+|(?<![A-Za-z])(?:" + "|".join(sorted(NAMES)) + r") [A-Z][a-z]{2,}(?![A-Za-z])")
CONTEXT = {
    "email": ("mail", "contact", "write to", "reach"),
    "ip": ("ip", "host", "server", "address", "login from"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("call", "tel", "phone", "mobile", "fax"),
    "secret": ("token", "key", "secret", "password", "passwd", "bearer", "credential"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social security", "tax id"),
    "local_phone": ("call", "tel", "phone", "mobile", "fax"),
    "person": ("name", "mr", "mrs", "dr", "signed", "by"),
}
OTHER_USE = ("version", "isbn", "sha256", "md5", "checksum", "commit", "order no", "page", "figure", "http://", "https://")
TEST_VALUES = frozenset("0.0.0.0 127.0.0.1 255.255.255.255 1.2.3.4".split())
TOP_DOMAINS = frozenset("com org net edu gov io de fr es uk eu info biz co us".split())

N_LABELERS = 6
# features of the span classifier: kind, then yes or no questions
N_FEATURES = len(KINDS) + 8


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    """Leftmost matches of the email pattern in linear time: each @ with the run
    of local characters before it and the domain after it."""
    low = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > low and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            low = m.end()
        at = text.find("@", max(at + 1, low))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, in the order of kinds and starts."""
    found = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(int(p) <= 255 if len(p) < 19 else not p.strip("0") or int(p[-19:]) <= 255 and not p[:-19].strip("0") for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(digits_of(m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def added_candidates(text: str, base) -> list[tuple[int, int, int]]:
    """Spans the method may add; none touches a base span or an earlier candidate."""
    starts, ends = [], []  # of the places taken, disjoint and in order
    for _, s, e in sorted(base, key=lambda x: x[1]):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    found = []
    for k, pattern in zip(range(len(BASE), len(KINDS)), (SECRET, IBAN, SSN, LOCAL_PHONE, PERSON)):
        for m in pattern.finditer(text):
            s, e = m.span()
            at = bisect.bisect_right(ends, s)  # the first place that ends behind s
            if at == len(ends) or starts[at] >= e:
                found.append((k, s, e))
                starts.insert(at, s)
                ends.insert(at, e)
    return found


def mod97(s: str) -> bool:
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


# per kind: whether the span has the kind's usual shape
SHAPES = {
    "email": lambda s, d, hexed, mixed: s.count("@") == 1 and ".." not in s,
    "ip": lambda s, d, hexed, mixed: True,
    "card": lambda s, d, hexed, mixed: len(d) in (16, 19),
    "phone": lambda s, d, hexed, mixed: 10 <= len(d) <= 13,
    "secret": lambda s, d, hexed, mixed: (hexed and len(s) >= 32) or (mixed and entropy(s) > 3.5),
    "iban": lambda s, d, hexed, mixed: 15 <= len(s) <= 34,
    "ssn": lambda s, d, hexed, mixed: s[:3] not in ("000", "666"),
    "local_phone": lambda s, d, hexed, mixed: len(d) == 10,
    "person": lambda s, d, hexed, mixed: True,
}
# per kind: a test of the value itself, 0 where the kind has none
CHECKS = {
    "email": lambda s, d: 0,
    "ip": lambda s, d: 1,
    "card": lambda s, d: 1,
    "phone": lambda s, d: 0,
    "secret": lambda s, d: 1 if entropy(s) > 3 else -1,
    "iban": lambda s, d: 1 if mod97(s) else -1,
    "ssn": lambda s, d: 1 if d[3:5] != "00" and d[5:] != "0000" else -1,
    "local_phone": lambda s, d: 1 if d[:1] not in ("0", "1") else -1,
    "person": lambda s, d: 0,
}


def votes_and_features(text: str, kind: int, s: int, e: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Votes of the labelers (1, -1, or 0 to abstain) and features of one span."""
    name, span = KINDS[kind], text[s:e]
    before, digits = text[max(0, s - 48) : s].lower(), digits_of(span)
    context = any(w in before for w in CONTEXT[name])
    other = any(w in before for w in OTHER_USE)
    clean = (s == 0 or not text[s - 1].isalnum()) and (e == len(text) or not text[e].isalnum())
    assigned = bool(re.search(r"[=:]\s*[\"']?$", text[max(0, s - 4) : s]))
    hexed = bool(re.fullmatch(r"[0-9a-fA-F]+", span))
    mixed = bool(digits) and any(c.isalpha() for c in span)
    shape, check = SHAPES[name](span, digits, hexed, mixed), CHECKS[name](span, digits)
    known = {
        "email": 1 if span.rpartition(".")[2].lower() in TOP_DOMAINS else 0, "ip": -1 if span in TEST_VALUES else 0,
        "card": -1 if len(set(digits)) == 1 else 0, "phone": -1 if len(set(digits)) <= 2 else 0,
        "person": 1 if any(p in NAMES for p in span.split()) else 0,
    }.get(name, 0)
    votes = (1 if shape else -1, check, 1 if context else 0, known, 1 if clean else -1, -1 if other else 0)
    long = len(span) >= 20
    flags = (context, other, clean, assigned, hexed, mixed, long, shape)
    return votes, tuple(int(kind == k) for k in range(len(KINDS))) + tuple(map(int, flags))


def estimate_reliabilities(patterns: np.ndarray, kinds: np.ndarray, weights: np.ndarray, rounds: int = 60):
    """EM with two classes over vote patterns and their counts: the probability
    that each pattern is personal data. Votes are independent given the class;
    each labeler has its own rates for, against and of abstaining in each class;
    each kind has its own share of true spans. Rates start from a trusting vote."""
    p = 1 / (1 + np.exp(-1.5 * patterns.sum(axis=1)))
    for _ in range(rounds):
        log = np.zeros((2, len(patterns)))
        for y, q in ((1, p), (0, 1 - p)):
            for j in range(patterns.shape[1]):
                rates = np.array([(weights * q * (patterns[:, j] == v)).sum() for v in (-1, 0, 1)]) + (1.0, 1.0, 1.0)
                # a labeler is assumed better than chance: a vote for never counts against
                rates += np.array([2.0 * (y == 0), 0, 2.0 * (y == 1)])
                rates /= rates.sum()
                log[y] += np.log(rates[patterns[:, j] + 1])
        for k in np.unique(kinds):
            mine = kinds == k
            share = ((weights * p)[mine].sum() + 1) / (weights[mine].sum() + 2)
            log[1, mine] += math.log(share)
            log[0, mine] += math.log(1 - share)
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -40, 40)))
    return p


def fit_span_classifier(x: np.ndarray, p: np.ndarray, weights: np.ndarray, steps: int = 400, rate: float = 0.5, penalty: float = 1e-3) -> np.ndarray:
    """Logistic regression on soft labels, by full-batch gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    share = weights / weights.sum()
    for _ in range(steps):
        w -= rate * (x.T @ (share * (1 / (1 + np.exp(-x @ w)) - p)) + penalty * w)
    return w


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return batch.column(batch.schema.names.index(name)).to_pylist()


def train(df: DataFrame, text: str = "text") -> np.ndarray:
    """Classifier weights from the vote patterns of all added candidates and base
    spans. The driver receives one row per distinct (votes, features), at most
    kinds x 3^6 x 2^8 whatever the data."""

    def votes(batches):
        for batch in batches:
            counts: dict = {}
            for t in _texts(batch, "_p_text"):
                base = base_spans(t)
                for k, s, e in base + added_candidates(t, base):
                    key = votes_and_features(t, k, s, e)
                    counts[key] = counts.get(key, 0) + 1
            yield pa.RecordBatch.from_pydict(
                {"votes": [list(v) for v, _ in counts], "features": [list(f) for _, f in counts], "n": list(counts.values())},
                schema=pa.schema([("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.int32())), ("n", pa.int64())]),
            )

    rows = (
        in_arrow(df.select(whole_text(text).alias("_p_text")), votes, "votes array<int>, features array<int>, n long")
        .groupBy("votes", "features").agg(F.sum("n").alias("n"))
        .collect()
    )
    if not rows:
        return np.zeros(N_FEATURES + 1)
    rows.sort(key=lambda r: (r["votes"], r["features"]))
    v, x = np.array([r["votes"] for r in rows]), np.array([r["features"] for r in rows], dtype=float)
    n = np.array([r["n"] for r in rows], dtype=float)
    p = estimate_reliabilities(v, x[:, : len(KINDS)].argmax(axis=1), n)
    return fit_span_classifier(x, p, n)


def spans_in(text: str, weights: np.ndarray, threshold: float = 0.5) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) of a text: its base spans and the candidates that the classifier accepts."""
    base = base_spans(text)
    more = []
    for k, s, e in added_candidates(text, base):
        x = np.array(votes_and_features(text, k, s, e)[1] + (1,))
        if 1 / (1 + math.exp(-float(x @ weights))) >= threshold:
            more.append((k, s, e))
    return sorted([(k, s, e, True) for k, s, e in base] + [(k, s, e, False) for k, s, e in more])


@keeps_names("_p_")
def find_personal_data(df: DataFrame, text: str = "text", weights: np.ndarray | None = None, threshold: float = 0.5) -> DataFrame:
    """``df`` with ``pii``: array of (kind, start, end, base), code points, end
    exclusive, ordered by kind as in ``KINDS`` and then start.

    Null and empty texts have no spans. Rows are independent: repeated rows get
    equal spans, an empty table stays empty. A column named pii is replaced.
    """
    if weights is None:
        weights = train(df, text)
    rows = df.drop("pii").withColumn("_p_text", whole_text(text))
    kind = "array<struct<kind:string,start:int,end:int,base:boolean>>"
    schema = T.StructType(rows.schema.fields[:-1] + T._parse_datatype_string(f"pii {kind}").fields)
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def find(batches):
        for batch in batches:
            out = [
                [{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in spans_in(t, weights, threshold)]
                for t in _texts(batch, "_p_text")
            ]
            columns = batch.columns[:-1] + [pa.array(out, spans_type)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1] + ["pii"])

    return in_arrow(rows, find, schema)


@keeps_names("_p_", "pii")
def redact(df: DataFrame, text: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """``df`` with every span of its text replaced by its kind in angle brackets;
    overlapping spans are replaced by the first. Null and empty texts stay as they are,
    repeated rows get equal texts, an empty table stays empty, other columns are kept."""
    if weights is None:
        weights = train(df, text)

    # spans are found and replaced in one pass, by one worker a task
    def replace(batches):
        for batch in batches:
            at = batch.schema.names.index(text)
            out = []
            for t in batch.column(at).to_pylist():
                spans = spans_in(t, weights) if t else ()
                if spans:
                    parts, low = [], 0
                    for k, start, end, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
                        if start >= low:
                            parts += [t[low:start], f"<{KINDS[k]}>"]
                            low = end
                    t = "".join(parts) + t[low:]
                out.append(t)
            columns = [pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    rows = df.withColumn(text, F.col(f"`{text}`").cast("string"))
    return in_arrow(rows, replace, rows.schema)


def span_digest(spans, base_only: bool) -> F.Column:
    """kind:start:end of the spans, comma-joined, in their order."""
    held = F.filter(spans, lambda x: x["base"]) if base_only else spans
    return F.array_join(F.transform(held, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def base_count(spans, kind: str) -> F.Column:
    """Base spans of one kind."""
    return F.size(F.filter(spans, lambda x: x["base"] & (x["kind"] == kind))).cast("long")
