"""Personal data by patterns, and terms that give it away by information-theoretic sanitisation.

1. Patterns find e-mail addresses, IP addresses, card numbers and phone numbers: the base spans, which
   always stay, and the protected entities (kind and value).
2. The words within ``REACH`` words of an entity, across line ends, are its context; words that touch a
   base span are none.  Pairs of an entity and a term that stand together in ``SUPPORT`` different contexts
   or more are candidates, so copies of a document are no evidence.
3. In how many texts a pair, its entity and its term occur is counted over the different texts of the
   corpus, each once whatever its copies.  From the counts come the share of a term's texts in which it
   stands near the entity, P(entity | term), and the pointwise mutual information in bits.  A term of
   ``BITS`` or more and a share of ``GENERALISE`` or more is generalised, of ``REMOVE`` or more removed,
   wherever it occurs in the corpus.

Three passes over the texts; between them only counts, spans and repeated texts are shuffled.
Tasks leave out words that cannot be candidates by a bit map of fixed size (2^24 bits), and know texts that
may have copies by another; only these are gathered and broadcast.  Exact joins and counts follow them, so a
crowded map costs time, never a result.

A null text is an empty one.  Spans are found by text, so rows that repeat an id and a text get the same
ones, and rows with a null id their own.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, map_batches, same

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "generalise", "remove")
REACH = 8
SUPPORT = 2
BITS = 3.0
GENERALISE, REMOVE = 0.5, 0.9
MAP_BITS = 1 << 24
EDGE = ".,;:!?()[]{}\"'|*#%$&<>-_/\\"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[TERM]", "remove": ""}

LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behinds only skip places where a match cannot begin, as the one before is greedy.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile("[^ \t\n\x0b\x0c\r]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Every address: the local part reaches back from an @ sign as far as its characters go."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = after = m.end()
        else:
            done = at + 1
        at = text.find("@", after)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def find(text: str) -> list[list[tuple[int, int]]]:
    """Base spans of each kind in order."""
    ips = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    cards = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                cards.append(m.span())
    phones = [m.span() for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15] if "+" in text else []
    return [emails(text), ips, cards, phones]


def term_of(word: str) -> str:
    """The normalised form of a word; empty for what cannot give an entity away."""
    word = word.lower().strip(EDGE)
    return word if len(word) >= 3 and any(map(str.isalpha, word)) and "@" not in word else ""


def entity_of(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind == 'email' else ''.join(c for c in value if c.isdigit() or kind == 'ip')}"


def contexts(text: str, spans: list[list[tuple[int, int]]], reach: int = REACH) -> list[tuple[str, str, int]]:
    """(entity, term, context) for the words around each span; context is a hash of them.  Each span gives
    one more with an empty term, so that an entity without words around it is counted too."""
    taken: list[list[int]] = []  # base spans of all kinds, joined where they overlap
    for start, end in sorted(s for found in spans for s in found):
        if taken and start < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    if not taken:
        return []
    starts, words, at = [], [], 0
    for m in WORD.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at == len(taken) or m.end() <= taken[at][0]:
            starts.append(m.start())
            words.append(m[0])
    out = []
    for kind, found in zip(BASE, spans):
        for start, end in found:
            left, right = bisect_left(starts, start), bisect_right(starts, end - 1)
            terms = [t for w in words[max(0, left - reach) : left] + words[right : right + reach] if (t := term_of(w))]
            mark = xxhash.xxh64_intdigest(" ".join(terms).encode()) - (1 << 63)
            out += [(entity_of(kind, text[start:end]), t, mark) for t in {"", *terms}]
    return out


FOUND = (
    "doc_id long, body long, spans array<struct<kind:int,start:int,end:int>>, near array<struct<entity:string,term:string,mark:long>>"
)


def findings(docs: DataFrame) -> DataFrame:
    """One row for each document: its base spans and what stands near them."""

    def batch(rows: dict) -> dict:
        out: dict[str, list] = {"doc_id": rows["doc_id"], "body": rows["body"], "spans": [], "near": []}
        for text in rows["text"]:
            spans = find(text)
            out["spans"].append([{"kind": k, "start": a, "end": b} for k, found in enumerate(spans) for a, b in found])
            out["near"].append([{"entity": e, "term": t, "mark": m} for e, t, m in contexts(text, spans)])
        return out

    return map_batches(_texts(docs), FOUND, batch)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("body"), text.alias("text"))


class TermMap:
    """A bit for the hash of each term of a table: 2 MB whatever the number of terms."""

    def __init__(self, terms: DataFrame):
        bit = terms.select((F.xxhash64("term").bitwiseAND(MAP_BITS - 1)).alias("bit"))
        words = bit.select((F.col("bit") / 32).cast("int").alias("word"), F.expr("shiftleft(1L, CAST(bit % 32 AS INT))").alias("mask"))
        rows = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).collect()  # at most 2^19 numbers
        bits = np.zeros(MAP_BITS // 32, np.uint32)
        for word, mask in rows:
            bits[word] = mask
        self.empty = not rows
        self.bits = terms.sparkSession.sparkContext.broadcast(bits)

    def holds(self, term: str) -> bool:
        bits = self.bits.value
        bit = xxhash.xxh64_intdigest(term.encode(), 42) & 32 * len(bits) - 1
        return bool(int(bits[bit >> 5]) >> (bit & 31) & 1)

    def __reduce__(self):
        return _term_map, (self.empty, self.bits)


def _term_map(empty, bits) -> TermMap:
    found = TermMap.__new__(TermMap)
    found.empty, found.bits = empty, bits
    return found


def _counted(texts: DataFrame, wanted: TermMap, copied: TermMap | None) -> DataFrame:
    """term, n: counts of rows body, text, summed up in the tasks; instead body, text for those that may have copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            later = {}
            for body, text in zip(*(c.to_pylist() for c in batch.columns)) if not wanted.empty else ():
                if copied is not None and copied.holds(str(body)):
                    later[body] = text
                else:
                    counts.update({t for w in set(WORD.findall(text)) if (t := term_of(w)) and wanted.holds(t)})
            n, m = [None] * len(counts), [None] * len(later)
            columns = [[*counts, *m], [*counts.values(), *m], [*n, *later], [*n, *later.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    arrow = pa.schema([("term", pa.string()), ("n", pa.int64()), ("body", pa.int64()), ("text", pa.string())])
    return texts.select("body", "text").mapInArrow(run, "term string, n long, body long, text string")


def document_counts(docs: DataFrame, terms: DataFrame, repeated: DataFrame) -> DataFrame:
    """term, n_docs: in how many different texts each of the terms occurs.  Texts that may have copies (``repeated``:
    column ``term``, the hash of the text) are brought together and counted once."""
    wanted = TermMap(terms)
    first = keep(_counted(_texts(docs), wanted, TermMap(repeated)), "pii-counts")
    once = first.filter("body IS NOT NULL").groupBy("body").agg(F.first("text").alias("text"))
    counted = first.select("term", "n").union(_counted(once, wanted, None).select("term", "n")).filter("term IS NOT NULL")
    return counted.groupBy("term").agg(F.sum("n").alias("n_docs"))


def disclosing_terms(docs: DataFrame, found: DataFrame, support: int = SUPPORT) -> DataFrame:
    """term, action (4 generalise, 5 remove), share, bits: every term that exceeds a disclosure threshold, with
    the figures of the entity it reveals most."""
    near = found.select("body", F.explode("near").alias("x")).select("body", "x.*").distinct()
    pairs = near.filter("term <> ''").groupBy("entity", "term").agg(F.count_distinct("body").alias("n_both"), F.count_distinct("mark").alias("n_contexts"))
    pairs = keep(pairs.filter(F.col("n_contexts") >= support), "pii-pairs")
    entities = near.filter("term = ''").select("entity", "body").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    bodies = found.groupBy("body").agg(F.count(F.lit(1)).alias("n"))
    repeated = bodies.filter("n > 1").select(F.col("body").cast("string").alias("term"))
    counts = document_counts(docs, pairs.select("term").distinct(), repeated)
    total = bodies.count()
    judged = pairs.join(entities, "entity").join(counts, "term").select(
        "term",
        (F.col("n_both") / F.col("n_docs")).alias("share"),
        F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_entity").cast("double") * F.col("n_docs"))).alias("bits"),
    ).filter((F.col("bits") >= BITS) & (F.col("share") >= GENERALISE))
    worst = judged.groupBy("term").agg(F.max("share").alias("share"), F.max("bits").alias("bits"))
    return worst.select("term", F.when(F.col("share") >= REMOVE, 5).otherwise(4).alias("action"), "share", "bits")


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, body, spans (kind, start, end) of every occurrence of the terms."""
    wanted = TermMap(terms)

    def batch(rows: dict) -> dict:
        out: dict[str, list] = {name: [] for name in ("doc_id", "body", "term", "start", "end")}
        for doc_id, body, text in zip(rows["doc_id"], rows["body"], rows["text"]) if not wanted.empty else ():
            for m in WORD.finditer(text):
                if (term := term_of(m[0])) and wanted.holds(term):
                    start = m.start() + m[0].lower().find(term)
                    for name, value in zip(out, (doc_id, body, term, start, start + len(term))):
                        out[name].append(value)
        return out

    met = map_batches(_texts(docs), "doc_id long, body long, term string, start int, end int", batch)
    spans = met.join(terms.select("term", "action"), "term").select("doc_id", "body", F.struct(F.col("action").alias("kind"), "start", "end").alias("span"))
    return spans.groupBy("doc_id", "body").agg(F.collect_set("span").alias("terms"))


def all_spans(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """doc_id, body, spans, terms (null where there are none): what the patterns and the disclosure find."""
    found = keep(findings(docs), "pii-findings")
    terms = keep(disclosing_terms(docs, found, support), "pii-terms")
    by_text = term_spans(docs, terms).select(F.col("doc_id").alias("tid"), F.col("body").alias("tbody"), "terms")
    return found.join(by_text, same(F.col("doc_id"), F.col("tid")) & (F.col("body") == F.col("tbody")), "left").select("doc_id", "body", "spans", "terms")


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in sorted(spans))


def scan(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms (disclosing terms that lie outside base spans)."""

    def batch(rows: dict) -> dict:
        names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_terms"]
        out: dict[str, list] = {"doc_id": rows["doc_id"]} | {n: [] for n in names}
        for spans, terms in zip(rows["spans"], rows["terms"]):
            base = [(s["kind"], s["start"], s["end"]) for s in spans]
            added = [(s["kind"], s["start"], s["end"]) for s in terms or []]
            added = [t for t in added if not any(a < t[2] and t[1] < b for _, a, b in base)]
            values = [sum(k == i for k, _, _ in base) for i in range(4)]
            values += [hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added)]
            for name, value in zip(names, values):
                out[name].append(value)
        return out

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_terms long"
    return map_batches(all_spans(docs, support).select("doc_id", "spans", "terms"), schema, batch)


def sanitised(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """doc_id, text with every base span and generalised term replaced by its label and removed terms gone."""
    spans = all_spans(docs, support).dropDuplicates(["doc_id", "body"]).select(F.col("doc_id").alias("sid"), F.col("body").alias("sbody"), "spans", "terms")
    texts = _texts(docs)
    joined = texts.join(spans, same(F.col("doc_id"), F.col("sid")) & (F.col("body") == F.col("sbody")))

    def batch(rows: dict) -> dict:
        out = []
        for text, spans, terms in zip(rows["text"], rows["spans"], rows["terms"]):
            parts, at = [], 0
            for start, end, kind in sorted((s["start"], s["end"], s["kind"]) for s in [*spans, *(terms or [])]):
                if start >= at:
                    parts += [text[at:start], LABELS[KINDS[kind]]]
                    at = end
            out.append("".join([*parts, text[at:]]))
        return {"doc_id": rows["doc_id"], "text": out}

    return map_batches(joined.select("doc_id", "text", "spans", "terms"), "doc_id long, text string", batch)
