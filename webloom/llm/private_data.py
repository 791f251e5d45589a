"""Personal data: pattern spans, and terms that give away the entities behind them.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Protected entities are each distinct value and
its telling parts: the domain of an address and the names before it, the network of an IP address, the issuer of a
card, the area of a phone number; parts recur where whole values do not. Over the whole corpus it is counted in how
many documents an entity e occurs, in how many a term t occurs, and in how many t stands within ``CONTEXT`` words of
e. With N documents, the share of what e is worth that t gives away is

    disclosure(e, t) = log(N * n(e, t) / (n(e) * n(t))) / log(N / n(e)),

pointwise mutual information over information content: 1 if t occurs with e alone. For a value that is there once it
is 1 - log n(t) / log N: with the threshold of 0.75, terms in at most the fourth root of N documents tell it. Terms
seen with e in at least ``SUPPORT`` documents (1: the only document of a value counts) and at or above ``THRESHOLD``
are spans of kind ``term`` where they stand near e. The sanitised text has the kind for each pattern span, and for
each such term its class (a number, a capitalised word) or nothing.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.plans.tables import Stash, spare

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 10
SUPPORT = 1
THRESHOLD = 0.75
#: Distinct words that a task counts before it passes the counts on.
HELD_WORDS = 200_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run that fails at its start fails at every later start, so matches begin at run starts only.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"[^\W_]{3,}")
NAME = re.compile(r"[a-z]{3,}")
AFTER, BEFORE = regex.compile(r"[^\W_]+"), regex.compile(r"(?r)[^\W_]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: each @ with what local characters stand before it and a domain after it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        else:
            done = at + 1  # no later address can begin at or before this @
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of kind, end) of all base spans, in order of start and kind."""
    spans = []
    if "@" in text:
        spans += [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(int(part[-4:]) <= 255 and not part[:-4].strip("0") for part in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def entities(kind: int, value: str) -> list[str]:
    """The value of a span and its telling parts."""
    if kind == 0:
        local, domain = value.lower().rsplit("@", 1)
        return [f"email:{local}@{domain}", f"domain:{domain}", *(f"name:{n}" for n in dict.fromkeys(NAME.findall(local)))]
    if kind == 1:
        parts = [str(int(p[-4:])) for p in value.split(".")]
        return [f"ip:{'.'.join(parts)}", f"network:{'.'.join(parts[:3])}"]
    digits = digits_of(value)
    return [f"card:{digits}", f"issuer:{digits[:6]}"] if kind == 2 else [f"phone:{digits}", f"area:{digits[:5]}"]


def words_beside(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The ``CONTEXT`` words on either side of a span that are long enough for terms; what goes on inside the span is no word."""
    word = lambda c: c.isalnum()
    for m in islice(BEFORE.finditer(text, 0, start), CONTEXT):
        if m.end() - m.start() >= 3 and not (m.end() == start and word(text[start])):
            yield m.span()
    for m in islice(AFTER.finditer(text, end), CONTEXT):
        if m.end() - m.start() >= 3 and not (m.start() == end and word(text[end - 1])):
            yield m.span()


def contexts(text: str, spans: list[tuple[int, int, int]]) -> dict[str, dict[str, set[tuple[int, int]]]]:
    """For each entity the terms near one of its spans, and where they stand; words in spans are no terms."""
    inside: list[tuple[int, int]] = []  # the spans in order, those that overlap made one
    for start, _, end in spans:
        if inside and start < inside[-1][1]:
            inside[-1] = (inside[-1][0], max(end, inside[-1][1]))
        else:
            inside.append((start, end))
    found: dict[str, dict[str, set[tuple[int, int]]]] = {}
    for start, kind, end in spans:
        near = [(a, b) for a, b in words_beside(text, start, end) if not in_spans(inside, a, b)]
        for entity in entities(kind, text[start:end]):
            terms = found.setdefault(entity, {})
            for a, b in near:
                terms.setdefault(text[a:b].lower(), set()).add((a, b))
    return found


def in_spans(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a..b meets one of the spans, which stand apart and in order."""
    at = bisect_left(spans, (b,))
    return at > 0 and spans[at - 1][1] > a


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCAN_SCHEMA = pa.schema([
    ("row", pa.int64()), ("id", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))), ("base_sha256", pa.string()), ("text_sha256", pa.string()),
    ("text", pa.string()), ("entity", pa.string()), ("term", pa.string()), ("at", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("n", pa.int64()),
])
SCAN = (
    "row long, id string, spans array<struct<start:int,kind:int,end:int>>, base_sha256 string, text_sha256 string, text string, entity string, term string, "
    "at array<struct<start:int,end:int>>, n long"
)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One reading of the texts: a row per document (with its text if it has spans), per entity in it, per entity and term near it, and word counts."""
    row = TaskContext.get().partitionId() << 36
    held: Counter[str] = Counter()

    def counts() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"term": t, "n": n} for t, n in held.items()], schema=SCAN_SCHEMA)

    for batch in batches:
        out = []
        for name, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            text = text or ""
            row += 1
            spans = base_spans(text)
            listed = [{"start": a, "kind": k, "end": b} for a, k, b in spans]
            digests = {"base_sha256": hashlib.sha256(spans_text(spans).encode()).hexdigest(), "text_sha256": hashlib.sha256(text.encode()).hexdigest()}
            out.append({"row": row, "id": name, "spans": listed, "text": text if spans else None} | digests)
            for entity, terms in contexts(text, spans).items() if spans else ():
                out.append({"row": row, "entity": entity})
                out += [{"row": row, "entity": entity, "term": term, "at": [{"start": a, "end": b} for a, b in sorted(places)]} for term, places in terms.items()]
            held.update({w.lower() for w in TERM.findall(text)})
            if len(held) > HELD_WORDS:
                yield counts()
                held.clear()
        yield pa.RecordBatch.from_pylist(out, schema=SCAN_SCHEMA)
    yield counts()


def rewritten(text: str, marks: list[dict]) -> str:
    """The text with base spans as their kind, disclosing terms as their class or gone."""
    out, done = [], 0
    for m in sorted(marks, key=lambda m: (m["start"], -m["end"])):
        if m["start"] < done:
            continue
        word = text[m["start"] : m["end"]]
        out += [text[done : m["start"]], f"[{KINDS[m['kind']].upper()}]" if m["kind"] < len(KINDS) else "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else ""]
        done = m["end"]
    return "".join([*out, text[done:]])


def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if text is None else rewritten(text, marks) for text, marks in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True)]
        shas = [known if text is None else hashlib.sha256(text.encode()).hexdigest() for known, text in zip(batch["text_sha256"].to_pylist(), texts, strict=True)]
        columns = {c: batch[c] for c in ("id", "spans", "base_sha256", "text_sha256")}
        yield pa.RecordBatch.from_pydict(columns | {"sanitised": pa.array(texts, pa.string()), "sanitised_sha256": pa.array(shas, pa.string())})


def disclosures(near: DataFrame, per_term: DataFrame, n_docs: int, support: int = SUPPORT) -> DataFrame:
    """(entity, term, disclosure) from (row, entity, term) rows, of which those without a term tell that the entity is there."""
    n_docs = F.lit(float(max(1, n_docs)))
    together = near.where("term is not null").groupBy("entity", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= support)
    per_entity = near.where("term is null").groupBy("entity").agg(F.count("*").alias("n_e"))
    worth = F.log(n_docs / F.col("n_e"))
    shared = F.log(n_docs * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    return together.join(per_entity, "entity").join(per_term, "term").where(F.col("n_e") < n_docs).select("entity", "term", (shared / worth).alias("disclosure"))


def find_private_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: (id, spans, base_sha256, text_sha256, sanitised, sanitised_sha256).

    ``spans`` is array<struct<start, kind, end>> in code points; kinds 0 to 3 are those of ``KINDS``, 4 is a disclosing
    term. ``sanitised`` is null where the text stays as it is. Null counts as empty text. Repeated rows are handled each
    and all count in the statistics. An empty table gives no rows; other columns are left out.
    """
    stash = Stash(docs.sparkSession, "private")
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    seen = stash.put(rows.mapInArrow(scan, SCAN), "scan")
    documents = seen.where("base_sha256 is not null").select("row", "id", "spans", "base_sha256", "text_sha256", "text")
    near = seen.where("entity is not null").select("row", "entity", "term", "at")
    per_term = seen.where("n is not null").groupBy("term").agg(F.sum("n").alias("n_t"))
    found = disclosures(near, per_term, documents.count(), support)
    disclosing = stash.put(found.where(F.col("disclosure") >= threshold).select("entity", "term"), "disclosing")
    told = (
        near.join(disclosing, ["entity", "term"])
        .select("row", F.explode("at").alias("p"))
        .groupBy("row")
        .agg(F.collect_set(F.struct(F.col("p.start").alias("start"), F.lit(len(KINDS)).alias("kind"), F.col("p.end").alias("end"))).alias("terms"))
    )
    every = F.array_sort(F.concat("spans", F.coalesce("terms", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    # only documents with spans can have terms: the others are not moved
    bare = documents.where(F.size("spans") == 0).withColumn("terms", F.lit(None).cast("array<struct<start:int,kind:int,end:int>>"))
    marked = documents.where(F.size("spans") > 0).join(told, "row", "left").unionByName(bare).select("id", every.alias("spans"), "base_sha256", "text_sha256", "text")
    out = marked.mapInArrow(rewrite, "id string, spans array<struct<start:int,kind:int,end:int>>, base_sha256 string, text_sha256 string, sanitised string, sanitised_sha256 string")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with sanitised texts; all other columns pass, whatever their names.

    Rows are told apart by id and text, so rows that share an id, and repeated rows, get each their own text. Null stays null.
    """
    found = find_private_data(docs, id_col, text_col, support, threshold).where("sanitised is not null")
    same_id, same_text, changed = spare(docs, "same_id", "same_text", "changed")
    found = found.select(F.col(id_col).alias(same_id), F.col("text_sha256").alias(same_text), F.col("sanitised").alias(changed)).dropDuplicates([same_id, same_text])
    joined = docs.join(found, docs[id_col].eqNullSafe(found[same_id]) & (F.sha2(docs[text_col], 256) == found[same_text]), "left")
    return joined.withColumn(text_col, F.coalesce(changed, text_col)).select(docs.columns)
