"""Personal data by weak supervision.

Spans of fixed patterns always count. Further candidates, and those spans, are judged by four
labelers that vote for, against or not at all: the span's own shape, gazetteers, words around it,
and the mix of its characters. Expectation-maximisation over the counts of vote patterns
estimates how far each labeler can be trusted; the resulting probabilities train a logistic
classifier on the spans' features, which decides on the further candidates.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tracehold.llm.common import stored
from tracehold.llm.toxicity import logistic

BASE = ("email", "ip", "card", "phone")
#: Kinds of the further candidates.
MORE = ("secret", "local_phone", "national_id")
KINDS = BASE + MORE
#: Characters before and after a span that the context labeler sees.
CONTEXT = 32

# Patterns, word lists and number ranges of the labelers.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]{6,}")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_LONG = re.compile(r"\S{12,}")
_SECRET = re.compile(r"[A-Za-z0-9_/+-]{12,}")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ENDINGS = frozenset("com org net edu gov info io de fr es uk eu us ca au ch at it nl".split())
_COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52",
              "55", "61", "81", "82", "86", "90", "91")
_SECRET_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "xoxb-", "xoxp-", "AIza", "eyJ")
_FOR = {
    "email": "mail contact write address", "ip": "ip host address server client from",
    "card": "card visa mastercard credit payment account", "phone": "phone tel call mobile fax cell number",
    "secret": "password passwd pwd secret token api key auth credential bearer",
    "local_phone": "phone tel call mobile fax cell number", "national_id": "ssn social security insurance id",
}
_AGAINST = "version release isbn issn doi page order invoice commit hash md5 sha1 sha256 checksum uuid chapter section".split()
_WORD = re.compile(r"[a-z]+[0-9]*")


class Candidate(NamedTuple):
    kind: int
    start: int
    end: int
    votes: int
    features: int


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: what stands before it is the longest allowed run."""
    floor, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                floor = domain.end()
                yield start, floor
                at = text.find("@", floor)
                continue
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns: leftmost non-overlapping per kind, failing ones dropped."""
    out = [(0, a, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        for run in _DOTTED.finditer(text):
            if run.group().count(".") >= 3:
                for m in _IP.finditer(text, run.start(), run.end()):
                    if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
                        out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                number = _digits(m.group())
                if 16 <= len(number) <= 19 and luhn(number):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_digits(m.group())) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def further_spans(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of candidates of other kinds that touch no known span; they may overlap each other."""
    found = []
    if _DIGITS.search(text):
        for run in _LONG.finditer(text):
            if _DIGITS.search(run.group()):
                for m in _SECRET.finditer(text, run.start(), run.end()):
                    body = m.group()
                    if _DIGITS.search(body) and any(c.isalpha() for c in body):
                        found.append((4, m.start(), m.end()))
        found += [(5, m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text)]
        found += [(6, m.start(), m.end()) for m in _NATIONAL_ID.finditer(text)]
    taken = sorted((a, b) for _, a, b in known)
    out, k = [], 0
    for kind, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or taken[k][0] >= b:
            out.append((kind, a, b))
    return out


def _shape(kind: str, body: str, number: str) -> int | None:
    if kind == "email":
        last = body.rsplit(".", 1)[-1]
        return int(last.isalpha() and 2 <= len(last) <= 24)
    if kind == "ip":
        return int(all(x == "0" or x[0] != "0" for x in body.split(".")))
    if kind == "card":
        return int(number[0] in "3456")
    if kind == "phone":
        return int(10 <= len(number) <= 15)
    if kind == "secret":
        return int(len(body) >= 16 and len(number) >= 4 and len(body) - len(number) >= 4)
    return int(number[0] not in "09") if kind == "national_id" else int(number[0] not in "01")


def _gazetteer(kind: str, body: str, number: str) -> int | None:
    if kind == "email":
        return 1 if body.rsplit(".", 1)[-1].lower() in _ENDINGS else None
    if kind == "ip":
        return 0 if body.split(".")[0].lstrip("0") in ("", "127", "255") else None
    if kind == "card":
        return int(number.startswith(("4", "34", "37", "6011", "65")) or "51" <= number[:2] <= "55")
    if kind == "phone":
        return 1 if number.startswith(_COUNTRIES) else None
    if kind == "secret":
        return 1 if body.startswith(_SECRET_STARTS) else None
    return None


def _context(kind: str, before: str, after: str) -> int | None:
    words = _WORD.findall(before.lower())[-4:]
    if any(w in _AGAINST for w in words):
        return 0
    if any(w.startswith(x) for w in words for x in _FOR[kind].split()):
        return 1
    return 0 if kind == "secret" and not re.search(r"[=:\"']\s*$", before) else None


def _mix(kind: str, body: str, number: str) -> int | None:
    if kind == "email":
        return 1 if re.search(r"[0-9._]", body.split("@")[0]) else None
    if kind == "ip":
        return int(len(set(body.split("."))) >= 2)
    if kind == "secret":
        changes = sum(a.isdigit() != b.isdigit() for a, b in zip(body, body[1:], strict=False))
        return int(changes >= 3 and len(set(body)) >= 8)
    return int(len(set(number)) >= 4)


def _bucket(x: int, edges: tuple[int, ...]) -> int:
    return sum(x >= e for e in edges)


def _side(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3


def judged(text: str, kind: int, start: int, end: int) -> Candidate:
    """A candidate with its votes (base 3: against, for, none) and its features."""
    name, body = KINDS[kind], text[start:end]
    before, after, number = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT], _digits(body)
    votes = 0
    for vote in (_shape(name, body, number), _gazetteer(name, body, number), _context(name, before, after), _mix(name, body, number)):
        votes = votes * 3 + (2 if vote is None else vote)
    parts = (_bucket(len(body), (12, 16, 20, 28, 40, 64, 128)), min(4, 5 * len(number) // max(1, len(body))),
             _side(before[-1:]), _side(after[:1]), int(bool(re.search(r"[=:]\s*[\"']?$", before))))
    features = 0
    for part, size in zip(parts, _SIZES, strict=True):
        features = features * size + part
    return Candidate(kind, start, end, votes, features)


LABELERS, _SIZES = 4, (8, 5, 4, 4, 2)
CANDIDATES = ArrayType(StructType([StructField(x, IntegerType()) for x in Candidate._fields]))


def find_candidates(documents: DataFrame) -> DataFrame:
    """All columns of the documents but text, and the judged candidates of each text.

    Base spans come first, by kind and start. Null texts are empty.
    """
    names = [f.name for f in documents.schema if f.name != "text"]
    schema = StructType([f for f in documents.schema if f.name != "text"]).add("candidates", CANDIDATES)
    kind = pa.list_(pa.struct([(x, pa.int32()) for x in Candidate._fields]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text"))
            found = []
            for text in texts:
                text = text.as_py() or ""
                base = base_spans(text)
                found.append([judged(text, *x)._asdict() for x in base + further_spans(text, base)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.names.index(n)) for n in names), pa.array(found, type=kind)], [*names, "candidates"])

    return documents.mapInArrow(work, schema)


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each vote pattern is right, and each labeler's (rate of 0, 1, none) by class.

    ``patterns`` holds a vote (0, 1 or 2 for none) per labeler. Labelers are taken as independent
    given the truth; weak priors say that a labeler is rather right than wrong.
    """
    votes = np.eye(3)[patterns]  # patterns x labelers x votes
    prior = np.array([[4.0, 1.0, 2.0], [1.0, 4.0, 2.0]])  # pseudo-counts by class
    share = np.where(votes[:, :, 1].sum(1) > votes[:, :, 0].sum(1), 0.8, 0.3)
    for _ in range(rounds):
        weight = np.stack([(1 - share) * counts, share * counts])
        rates = np.einsum("cp,plv->clv", weight, votes) + prior[:, None, :]
        rates /= rates.sum(axis=2, keepdims=True)
        log = np.log((weight.sum(axis=1) + 1) / (weight.sum() + 2))[:, None] + np.einsum("plv,clv->cp", votes, np.log(rates))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - share).max() < 1e-9:
            break
        share = new
    return share, rates


def _encoded(kind: np.ndarray, features: np.ndarray) -> np.ndarray:
    """One-hot rows: kind, each feature, and an intercept."""
    columns = [np.ones((len(kind), 1)), np.eye(len(KINDS))[kind]]
    rest = features.copy()
    for size in reversed(_SIZES):
        columns.append(np.eye(size)[rest % size])
        rest //= size
    return np.hstack(columns)


def train(candidates: DataFrame) -> np.ndarray:
    """Weights of the span classifier, from the counts of (kind, votes, features) over all documents.

    The table of counts is bounded by the product of their values, whatever the corpus.
    """
    rows = candidates.select(F.explode("candidates").alias("x")).groupBy("x.kind", "x.votes", "x.features").count().toPandas()
    width = _encoded(np.zeros(1, dtype=int), np.zeros(1, dtype=int)).shape[1]
    if not len(rows):
        return np.zeros(width)
    rows = rows.sort_values(["kind", "votes", "features"])
    share = np.zeros(len(rows))
    for kind in rows["kind"].unique():
        mine = (rows["kind"] == kind).to_numpy()
        codes, where = np.unique(rows["votes"][mine], return_inverse=True)
        counts = np.bincount(where, weights=rows["count"][mine])
        patterns = (codes[:, None] // 3 ** np.arange(LABELERS - 1, -1, -1)) % 3
        share[mine] = reliabilities(patterns, counts)[0][where]
    x = _encoded(rows["kind"].to_numpy(), rows["features"].to_numpy())
    return logistic(x, share, rows["count"].to_numpy(float), penalty=1.0)


def _decided(candidates: list[dict], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Base spans, and further candidates that the classifier takes; by kind and start.

    Of further ones that it takes and that overlap, the first stays, and of these the longest.
    """
    out = [(c["kind"], c["start"], c["end"]) for c in candidates if c["kind"] < len(BASE)]
    more = [c for c in candidates if c["kind"] >= len(BASE)]
    if more:
        x = _encoded(np.array([c["kind"] for c in more]), np.array([c["features"] for c in more]))
        end = 0
        for c in sorted((c for c, z in zip(more, x @ weights, strict=True) if z >= 0), key=lambda c: (c["start"], -c["end"])):
            if c["start"] >= end:
                out.append((c["kind"], c["start"], c["end"]))
                end = c["end"]
    return sorted(out)


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text without what any span covers: each stretch is replaced by the kinds of its spans in angle brackets."""
    parts, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            parts += [text[at:a], f"<{KINDS[kind]}>"]
        elif b > at:
            parts.append(f"<{KINDS[kind]}>")
        at = max(at, b)
    return "".join([*parts, text[at:]])


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row.

    ``spans`` lists base spans and those that the method adds as kind:start:end in code points,
    comma-joined, by kind and start. Null and empty texts have none. Repeated rows and rows
    without a doc_id are rows like others; other columns are not read.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, _ = stored(find_candidates(rows), "pii-candidates")
    weights = train(found)
    counts = [f"n_{k}" for k in BASE]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, digests, spans = [], [], []
            for one in batch.column(1).to_pylist():
                decided = _decided(one, weights)
                base = [x for x in decided if x[0] < len(BASE)]
                numbers.append([sum(x[0] == k for x in base) for k in range(len(BASE))])
                digests.append(hashlib.sha256(_told(base).encode()).hexdigest())
                spans.append(_told(decided))
            table = np.array(numbers, dtype=np.int64).reshape(-1, len(BASE))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *(pa.array(table[:, k]) for k in range(len(BASE))), pa.array(digests, type=pa.string()),
                pa.array(spans, type=pa.string())], ["doc_id", *counts, "base_sha256", "spans"])

    return found.mapInArrow(work, f"doc_id long, {', '.join(f'{c} long' for c in counts)}, base_sha256 string, spans string")


def redacted(documents: DataFrame) -> DataFrame:
    """The documents, all columns, with personal data replaced by its kind in angle brackets.

    Spans that overlap are replaced as a whole, by the kinds of all that reach further. Texts without spans, null
    and empty ones stay as they are; every row stays, repeated rows and rows without a doc_id too.
    """
    boxed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), F.col("text").cast("string").alias("text"))
    found, _ = stored(find_candidates(boxed), "pii-candidates")
    weights = train(found)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            texts = []
            for text, one in zip(rows.field("text"), batch.column(1).to_pylist(), strict=True):
                spans = _decided(one, weights)
                texts.append(replaced(text.as_py(), spans) if spans else text.as_py())
            yield pa.RecordBatch.from_arrays([rows, pa.array(texts, type=pa.string())], ["_row", "_text"])

    schema = StructType([found.schema["_row"]]).add("_text", StringType())
    out = found.mapInArrow(work, schema)
    return out.select(*[F.col("_text").alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in documents.columns])
