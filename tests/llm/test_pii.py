"""Base spans against plain regular expressions; estimation and training on known votes."""

import hashlib
import random
import re

from tablepact.llm.pii import BASE_KINDS, GATES, PATTERNS, estimate, find_pii, iban_checks, spot, valid
from tablepact.llm.queries import QUERIES
from tablepact.llm.spans import located
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def good(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in found.split(".")),
        "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def brute(text):
    spans = [
        (m.start(), rank, kind, m.end())
        for rank, kind in enumerate(BASE_KINDS)
        for m in re.finditer(PLAIN[kind], text or "")
        if good(kind, m[0])
    ]
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))


ODD = [
    None,
    "",
    "a@b.c%d@e.f a@b.c@d.e x@y @a.b a@@b.c é@ü.de mé+tag@x-y.co.uk.",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.1.1 1.2.3 999.1.2.3.4 255.255.255.255",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 378282246310005 0000000000000",
    "+1 (988) 555-2485 +49-170.1234567 +1 2 +12345678901234567 ++4912345678 +4 ( ( 12345678)",
    "𝒳😀 mail bob.1@x.com 😀 1.1.1.1 and +1 (988) 555-2485",
    "a" * 3_000,
    "1" * 3_000,
    "a.b@c" + ".d" * 30_000,
    "1.1.1.1 " * 5_000,
    "x@y.z " * 3_000,
]


def test_base_spans_of_odd_texts(spark):
    rows = [(i, t, "k", i) for i, t in enumerate(ODD * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, start long").repartition(2)
    found = {r.doc_id: r for r in find_pii(docs.withColumnRenamed("base", "kind")).collect()}
    assert found.keys() == {r[0] for r in rows}
    for i, text, *_ in rows:
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found[i].base) == brute(text), (i, (text or "")[:60])
        assert {tuple(s) for s in found[i].base} <= {tuple(s) for s in found[i].spans}
        assert found[i].kind == "k" and found[i].start == i


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = QUERIES["op1_pii"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [base.count(f"{k}:") for k in BASE_KINDS]
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_secrets_are_added(spark):
    """Key-like words with a random value are found, and ordinary assignments are not."""
    rows = [(i, f"user login {'password' if i % 2 else 'api_key'}=b7db7aa4a5fcc{7000 + i} then on") for i in range(60)]
    rows += [(100 + i, f"see width:{'a' * 9} and x") for i in range(60)]
    found = {r.doc_id: r.spans for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all([s.kind for s in found[i]] == ["secret"] for i in range(60))
    assert not any(found[100 + i] for i in range(60))


def test_long_runs_take_no_square_time(spark):
    rows = [(1, "a" * 500_000), (2, "1" * 500_000), (3, "a.b@c" + ".d" * 100_000)]
    found = {r.doc_id: r.base for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == [] and found[2] == [] and [s.end for s in found[3]] == [len(rows[2][1])]


def test_empty_table(spark):
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate_tells_good_votes_from_bad():
    likely = estimate({("card", "+++0-+"[:6]): 5, ("card", "+++00+"): 80, ("card", "--000-"): 300, ("card", "0-00--"): 60})
    assert likely["card", "+++00+"] > 0.95 and likely["card", "--000-"] < 0.05


def test_many_matches_keep_their_places(spark):
    row = spark.range(1).select(located(F.lit("ab " * 1000), F.lit("a")).alias("m")).first()
    assert [m.start for m in row.m] == [3 * i for i in range(1000)]


def test_matches_pass_their_gates(spark):
    """No text is left out that holds a match: any, or for the base kinds a valid one."""
    rng = random.Random(4)
    pieces = ["API_KEY=abcd1234efgh", "DB_PASSWORD: hunter2hunter2", "key_:abcdefgh", "a@b.c", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111",
              "+49 (170) 1234567", "(030) 12 34 56", "030/12.34", "DE44 5001 0517 5407 3249 31", "123-45-6789", "Anna Schmidt"]
    texts = pieces + ["".join(rng.choices("Aaz_=: 0149.+-@()/", k=rng.randint(10, 40))) for _ in range(3000)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for kind, pattern in PATTERNS.items():
        found = F.filter(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda m: valid(kind, m))  # noqa: B023
        matched = docs.where(F.size(found) > 0)
        assert matched.count() and matched.where(~F.col("text").rlike(GATES[kind])).collect() == [], kind


def test_upper_case_keys_are_candidates(spark):
    docs = spark.createDataFrame([(1, "API_KEY=abcd1234efgh"), (2, "DB_PASSWORD: hunter2hunter2")], "doc_id long, text string")
    found = {r.doc_id: [(c.kind, c.start, c.end) for c in r.candidates] for r in spot(docs, "text").collect()}
    assert found == {1: [("secret", 0, 20)], 2: [("secret", 0, 27)]}


def test_long_secrets_are_whole(spark):
    value = "b7Db-7a_A.4f" * 1000
    found = spot(spark.createDataFrame([(1, f"see api_token={value} then")], "doc_id long, text string"), "text").first()
    assert [(c.start, c.end) for c in found.candidates if c.kind == "secret"] == [(4, 14 + len(value))]


SECRETS = [
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"', "token='a1b2c3d4e5f6'", "api_key: abcd1234efgh",
    "API_KEY=abcd1234efgh", "db2_password : hunter2hunter2", "secret=" + "q1" * 4_000,
]


def test_secrets_in_quotes_and_blanks(spark):
    """Each is one span over the whole value; prose, links and dates beside them have none."""
    clean = ["see https://example.org/a/page1234 for more", "on 2024-01-15 we met: everybody12 was there", "ratio: 12345678 to 1", "the note: nothing_here"]
    texts = [f"login with {s}\nand go on" for s in SECRETS * 6] + clean * 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [tuple(s) for s in r.spans if s.kind == "secret"] for r in find_pii(docs).collect()}
    for i, text in enumerate(texts):
        if text in clean:
            assert found[i] == [], text
        else:
            (kind, start, end), secret = found[i][0], SECRETS[i % len(SECRETS)]
            assert len(found[i]) == 1 and start == len("login with ") and end in (start + len(secret), start + len(secret) - 1)


def test_every_secret_of_the_documents_is_found(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    told = {d for d, t in texts.items() if re.search(r'token = "[0-9a-f]{20,}"', t, re.I)}
    found = {r.doc_id for r in QUERIES["op1_pii"](spark, folder).collect() if "secret:" in r.spans}
    assert told and found == told


def test_check_digits_of_accounts(spark):
    good = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606"]
    rows = [(g, True) for g in good] + [(g[:-1] + ("1" if g[-1] != "1" else "2"), False) for g in good]
    df = spark.createDataFrame(rows, "found string, good boolean")
    assert all(r.ok == r.good for r in df.select("good", iban_checks(F.col("found")).alias("ok")).collect())
