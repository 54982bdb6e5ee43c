import hashlib
import random
import re

from helpers import make_docs, rows_of

from sherdline.llm import pii

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    return [
        [m.span() for m in re.finditer(EMAIL, text)],
        [m.span() for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))],
        [m.span() for m in re.finditer(CARD, text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))],
        [m.span() for m in re.finditer(PHONE, text) if 8 <= len(digits(m[0])) <= 15],
    ]


def expected(rows):
    out = []
    for doc_id, text in rows:
        spans = plain(text)
        joined = ",".join(f"{kind}:{a}:{b}" for kind, found in zip(pii.BASE, spans) for a, b in found)
        out.append((doc_id, *map(len, spans), hashlib.sha256(joined.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def test_patterns_on_random_strings():
    rng = random.Random(3)
    parts = [*"aZ9.@_%+- 0125()\n-", "a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (269) 555-3296", "999", "@@", "é", "٣"]
    for _ in range(30_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 40)))
        assert pii.find(text) == plain(text), repr(text)


def test_patterns_are_linear_on_long_runs():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 50_000, "1 " * 100_000, "a@" * 50_000):
        pii.find(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_documents_against_plain(documents, odd_docs, odd_rows, no_docs):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    found = pii.scan(documents)
    assert rows_of(found, *COLUMNS) == expected(rows)
    for r in found.collect():
        mine = [s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE]
        assert hashlib.sha256(",".join(mine).encode()).hexdigest() == r.base_sha256
    assert rows_of(pii.scan(odd_docs), *COLUMNS) == expected(odd_rows)
    assert pii.scan(no_docs).collect() == []


def corpus():
    """A nickname that stands with one address only, a title that often does, and words that say nothing."""
    rng = random.Random(5)
    common = ["the", "meeting", "notes", "about", "project", "weather", "garden", "music", "letter", "river", "window"]
    some = lambda n: " ".join(rng.choices(common, k=n))
    rows = [(i, f"{some(6)} Zorblax, the treasurer wrote from z.b@mail.example.com {some(6)}") for i in range(5)]
    rows += [(10 + i, f"{some(30)} treasurer {some(5)}") for i in range(4)]
    rows += [(20, f"{some(10)} as zorblax said {some(10)}")]
    rows += [(100 + i, some(40)) for i in range(120)]
    return rows + [(300 + i, "Copyword stands with q@mail.example.com in one text only") for i in range(6)]


def test_terms_that_disclose_an_entity(spark):
    rows = corpus()
    docs = make_docs(spark, rows)
    terms = {r.term: r.action for r in pii.disclosing_terms(docs, pii.findings(docs)).collect()}
    assert terms == {"zorblax": 4, "treasurer": 4, "wrote": 5, "from": 5}  # 5 of 6 documents, 5 of 9, always, always
    texts = dict(rows)
    found = {r.doc_id: r for r in pii.scan(docs).collect()}
    for s in found[20].spans.split(","):
        kind, a, b = s.split(":")
        assert (kind, texts[20][int(a) : int(b)]) == ("generalise", "zorblax")
    assert found[100].spans == "" and found[300].n_terms == 0 and found[0].n_terms == 4
    out = dict(rows_of(pii.sanitised(docs), "doc_id", "text"))
    assert "[TERM] said" in out[20] and "[EMAIL]" in out[0] and "Zorblax" not in out[0] and "wrote" not in out[0]
    assert out[100] == texts[100]


def test_the_bit_map_only_lets_more_pass(spark, monkeypatch):
    docs = make_docs(spark, corpus())
    before = rows_of(pii.scan(docs), "doc_id", "spans")
    monkeypatch.setattr(pii, "MAP_BITS", 64)
    assert rows_of(pii.scan(docs), "doc_id", "spans") == before


def test_copies_do_not_hide_a_term(spark):
    """Texts that are copied a hundred times disclose what they disclose without copies."""
    rows = corpus()
    copied = rows + [(1000 * k + i, text) for k in range(1, 100) for i, text in rows[:5]]
    figures = []
    for docs in (make_docs(spark, rows), make_docs(spark, copied).repartition(7)):
        figures.append(rows_of(pii.disclosing_terms(docs, pii.findings(docs)), "term", "action", "share", "bits"))
    assert figures[0] == figures[1] and ("zorblax", 4) in [f[:2] for f in figures[0]]


def test_two_contexts_and_words_of_other_lines(spark):
    rng = random.Random(6)
    rows = [(1, "the address\nQuuxley\n\nq@mail.example.com\nnever"), (2, "again Quuxley\n" + "z" * 400 + " q@mail.example.com indeed")]
    rows += [(10 + i, " ".join(rng.choices(["the", "never", "again", "indeed", "address"], k=20))) for i in range(60)]
    docs = make_docs(spark, rows)
    assert rows_of(pii.disclosing_terms(docs, pii.findings(docs)), "term", "action") == [("quuxley", 5)]
    assert pii.contexts("x" * 500 + "abc@d.ef,abc@d.ef word", pii.find("x" * 500 + "abc@d.ef,abc@d.ef word"))[-1][0].startswith("email:")
