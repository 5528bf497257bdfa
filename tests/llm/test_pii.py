import hashlib
import re

from siftwell.llm import pii

KINDS = ("email", "ip", "card", "phone")
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in text.split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def brute(text):
    found = []
    for rank, kind in enumerate(KINDS):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(PLAIN[kind], text or "") if holds(kind, m.group())]
    return sorted(found)


TEXTS = [
    None, "", "no data", "a@b.c@d.e x.y@z-1.co.uk. é a@b", "mail: müller.x@host.de, call +49 (30) 123-4567-8",
    "ip 1.2.3.4.5 and 256.1.1.1, 001.002.003.004, 1..2.3.4.5 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 5 4111111111111111",
    "12 34 56 78 90 12 34 56 78 90 12", "+1 +12 345 678 90 () +4930123456- +1.2.3.4.5.6.7.8.9", "x" * 50000 + "@a.b", "1" * 30000, "1 " * 9000,
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 or DE89 3704 0044 0532 0130 01", "tel. (030) 123-4567 but 030 123-4567", "ssn 123-45-6789 / 123-45-6789",
    "😀 a@b.co 😀 10.0.0.1", "a@b.co " * 700, "a@-.-", "%@a.b.", "0000 0000 0000 0000", "1-1-1-1-1-1-1-1-1-1-1-1-1", "a@b\n.c",
]


def check(spark, rows):
    got = {}
    import tempfile

    path = tempfile.mkdtemp() + "/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    for r in pii.op2_pii(spark, path.rsplit("/", 1)[0]).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, text in rows:
        want = brute(text)
        for r in got[i]:
            assert [r[f"n_{k}"] for k in KINDS] == [sum(x[2] == k for x in want) for k in KINDS], text
            joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (text, r.spans)
            assert set(filter(None, joined.split(","))) <= set(r.spans.split(",")) | {""}
    return got


def test_odd_texts(spark):
    got = check(spark, list(enumerate(TEXTS)) + [(3, TEXTS[3])])
    spans = {i: [x.split(":")[0] for x in r[0].spans.split(",") if x] for i, r in got.items()}
    assert spans[12] == ["iban", "iban"] and spans[13] == ["local_phone", "local_phone"] and spans[14] == ["ssn", "ssn"]


def test_random_texts(spark):
    import random

    r = random.Random(5)
    pieces = ["a@b", ".c", "1", "12", ".", "-", " ", "+", "(", ")", "4111", "é", "255", "@", "\n", "0", "x", "😀", "4242424242424242"]
    check(spark, [(i, "".join(r.choice(pieces) for _ in range(r.randrange(60)))) for i in range(1500)])


def test_tables(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, rows)


def test_extra_columns(spark):
    d = spark.createDataFrame([("t a@b.co", "x", 1)], "text string, spans string, near int")
    row = pii.spans(d).first()
    assert row.near == 1 and row.text == "t a@b.co" and row.spans[0].kind == "email" and row.spans[0].start == 2


def test_cards_in_pairs_and_single_digits(spark):
    number = "4111111111111111"
    texts = [between.join(number[i : i + n] for i in range(0, 16, n)) for n in (1, 2) for between in " -"]
    got = check(spark, list(enumerate(texts)))
    assert all(got[i][0].n_card == 1 for i in range(4))


IBAN = "DE89 3704 0044 0532 0130 00"


def test_ibans_before_other_words(spark):
    plain = IBAN.replace(" ", "")
    texts = [f"{x}{rest}" for x in (plain, IBAN) for rest in (" EUR", " BIC COBADEFFXXX", " Bank", " 12 EUR", ", GB82WEST12345698765432 A1", "", ".")]
    texts += [f"AT61 {IBAN}", f"AT61 1904 3002 3457 3201 {IBAN} ABC", "é " * 50 + f"{plain} NOT", f"XX00 1234 5678 9012 345 {IBAN}"]
    wrong = [f"{plain}X", f"{plain}x", IBAN[:-1] + "1 EUR", f"1{plain}", plain[:-1]]
    rows = spark.createDataFrame(list(enumerate(texts + wrong)), "doc_id long, text string")
    got = {r.doc_id: [r.text[x.start : x.end] for x in r.spans if x.kind == "iban"] for r in pii.spans(rows).collect()}
    for i, text in enumerate(texts):
        assert got[i] == [x for x in ("AT61 1904 3002 3457 3201", plain, IBAN, "GB82WEST12345698765432") if x in text], text
    assert not any(got[i] for i in range(len(texts), len(texts + wrong)))


def test_iban_of_an_unlisted_country(spark):
    body = "1234567890123"
    number = f"ZZ{98 - int(body + '353500') % 97:02}{body}"
    rows = spark.createDataFrame([(f"{number} Bank",), (f"{number} is",)], "text string")
    assert [[(x.start, x.end) for x in r.spans if x.kind == "iban"] for r in pii.spans(rows).collect()] == [[(0, len(number))]] * 2


def test_context_on_either_side(spark):
    """Score with the 40 characters about a span, whatever lies in them."""
    texts = ["tel. (030) 123-4567 but 030 123-4567", "ssn 123-45-6789 / 123-45-6789", "123-45-6789 / 123-45-6789 ssn", "030 123-4567, 030 123-4568 mobile", f"{IBAN} konto", f"konto {IBAN} {IBAN}", f"{IBAN} " + "x" * 40 + " konto", "1.2.3.4 " * 300 + "host"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.spans(rows).collect():
        assert len(r.spans) == (1 if r.doc_id in (4, 6) else 300 if r.doc_id == 7 else 2)
        for x in r.spans:
            near = f"{r.text[max(0, x.start - 40) : x.start]} {r.text[x.end : x.end + 40]}".lower()
            base, more = pii.SCORES[x.kind]
            assert x.score == (base + more if re.search(pii.CONTEXT[x.kind], near) else base), (r.text, x)
