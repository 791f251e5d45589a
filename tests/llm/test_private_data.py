"""Base spans against SQL, disclosing terms against brute force, and sanitised texts."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import duckdb
import pytest

from webloom.llm import catalog
from webloom.llm.private_data import CONTEXT, base_spans, find_private_data, sanitise, spans_text

SPACED = r"[\x20-]"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": rf"[0-9]({SPACED}?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(length({DIGITS})), lambda i: (({DIGITS})[length({DIGITS}) - i]::int * (1 + i % 2)) // 10 + (({DIGITS})[length({DIGITS}) - i]::int * (1 + i % 2)) % 10)) % 10 = 0"
KEPT = {
    "email": "true",
    "ip": "list_max(list_transform(string_split(v, '.'), lambda x: x::hugeint)) <= 255",
    "card": f"length({DIGITS}) between 12 and 19 and {LUHN}",
    "phone": f"length({DIGITS}) between 9 and 15",
}


def base_sql() -> str:
    kinds = " union all ".join(
        f"""select r, {k} as o, '{kind}' as kind, s, s + length(v) as e from (
          select r, m[i] as v, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as s
          from (select *, unnest(range(1, len(m) + 1)) as i from (select r, regexp_extract_all(t, '{pattern}') as m, string_split_regex(t, '{pattern}') as p from d))
        ) where {KEPT[kind]}"""
        for k, (kind, pattern) in enumerate(PATTERNS.items())
    )
    counts = ", ".join(f"coalesce(sum((kind = '{kind}')::bigint), 0)::bigint as n_{kind}" for kind in PATTERNS)
    return f"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents), k as ({kinds})
      select doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, o), '')) as base_sha256 from d left join k using (r) group by r, doc_id"""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not here")
def test_base_columns_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    want = con.execute(base_sql()).fetchall()
    got = catalog.op7_find_private_data(spark, "/root/testdata/sf0.01")
    rows = got.collect()
    assert sorted((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows) == sorted(want)
    # the method adds spans here, and the sanitised texts of just those documents that have any are other texts
    texts = {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in con.execute("select doc_id, text from documents").fetchall()}
    assert sum(r["n_terms"] for r in rows) > 0
    assert all((r["spans"] != "") == (r["sanitised_sha256"] != texts[r["doc_id"]]) for r in rows)


def plain_base(text):
    """Base spans by the contract's patterns, read with ``re``."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + j % 2) for j, d in enumerate(reversed(digits))]
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and sum(v // 10 + v % 10 for v in doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if ok[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_on_random_text():
    draw = random.Random(3)
    pieces = ["a", "b.c", "@", ".", "x-y.org", "10", "255", "256", " ", "-", "+", "(", ")", "4111", "1111", "0", "+49", "é", "\n", "..", "@@"]
    for _ in range(4000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randrange(1, 40)))
        assert base_spans(text) == plain_base(text), text


def parts_of(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == 0:
        local, domain = value.lower().split("@")
        return {("email", value.lower()), ("domain", domain)} | {("name", n) for n in re.findall("[a-z]{3,}", local)}
    if kind == 1:
        parts = [str(int(p)) for p in value.split(".")]
        return {("ip", tuple(parts)), ("network", tuple(parts[:3]))}
    return {("card", digits), ("issuer", digits[:6])} if kind == 2 else {("phone", digits), ("area", digits[:5])}


def brute_spans(texts, threshold=0.75):
    """Spans of each text with disclosing terms, all counts by plain loops."""
    holds, beside, has = [], [], Counter()
    for text in texts:
        spans = base_spans(text)
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
        holds.append({e for a, k, b in spans for e in parts_of(k, text[a:b])})
        has.update({text[a:b].lower() for a, b in words if b - a >= 3})
        near = []
        for a, k, b in spans:
            before = [w for w in words if w[1] <= a][-CONTEXT:]
            after = [w for w in words if w[0] >= b][:CONTEXT]
            for x, y in before + after:
                if y - x >= 3 and not any(x < d and c < y for c, _, d in spans):
                    near += [(e, text[x:y].lower(), x, y) for e in parts_of(k, text[a:b])]
        beside.append(near)
    n, n_e = len(texts), Counter(e for h in holds for e in h)
    n_et = Counter((e, t) for near in beside for e, t in {(e, t) for e, t, _, _ in near})
    tells = {(e, t) for (e, t), k in n_et.items() if n_e[e] < n and math.log(n * k / (n_e[e] * has[t])) >= threshold * math.log(n / n_e[e])}
    return [sorted(set(base_spans(text)) | {(x, 4, y) for e, t, x, y in near if (e, t) in tells}) for text, near in zip(texts, beside, strict=True)]


def corpus():
    draw = random.Random(5)
    common = [f"word{c}" for c in "abcdefghijklmnopqrst"]
    texts = []
    for k in range(120):
        words = [draw.choice(common) for _ in range(30)]
        if k % 6 == 0:
            # once: a value with a rare word beside it; again and again: a domain with its word, behind a very long one
            words[15:15] = [f"Rarity{'abcdefghijklmnopqrstu'[k // 6]}", f"jane.doe{k}@mail.example.org", "y" * 300, "Zanzibar"]
        if k % 15 == 1:
            words[5:5] = ["caller", f"+49 1234 567{k:03d}", "or", "10.0.0.7", "of", "2024"]
        texts.append(" ".join(words))
    return [*texts, texts[0], None, "", "a@b.co", "x" * 50_000 + " k@l.example.net end"]


def test_disclosing_terms(spark):
    texts = corpus()
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = brute_spans([t or "" for t in texts])
    got = {r["doc_id"]: r for r in find_private_data(docs).collect()}
    assert {k: [tuple(s) for s in r["spans"]] for k, r in got.items()} == dict(enumerate(want))
    terms = {texts[k][a:b] for k, spans in enumerate(want) for a, kind, b in spans if kind == 4}
    assert {"Zanzibar", "Raritya", "caller", "2024"} <= terms and not any(t.startswith("word") for t in terms)
    assert got[0]["sanitised"].count("[EMAIL]") == 1 and "[NAME] [EMAIL]" in got[0]["sanitised"] and "Zanzibar" not in got[0]["sanitised"]
    assert "[NUMBER]" in got[1]["sanitised"] and "[PHONE] or [IP] of" in got[1]["sanitised"]
    for k, r in got.items():
        assert r["sanitised_sha256"] == hashlib.sha256((r["sanitised"] if r["sanitised"] is not None else texts[k] or "").encode()).hexdigest()
    assert spans_text(base_spans("a@b.co")) == "email:0:6"


def test_sanitise_rows_that_share_an_id(spark):
    rows = [(1, "mail me@here.example.com now", "x"), (1, "call +1 234 567 890 now", "y"), (1, "call +1 234 567 890 now", "y"), (1, None, "z"), (2, "nothing at all", "w"), (None, "me@there.example.com", "v")]
    rows += [(10 + k, "mail and call now, nothing more", "u") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, same_id string")
    out = sanitise(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"], r["same_id"]) for r in out.where("doc_id < 10 or doc_id is null").collect())
    assert got == Counter({(1, "mail [EMAIL] now", "x"): 1, (1, "call [PHONE] now", "y"): 2, (1, None, "z"): 1, (2, "nothing at all", "w"): 1, (None, "[EMAIL]", "v"): 1})
    assert sanitise(docs.where("false")).count() == 0
