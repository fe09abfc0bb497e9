"""Personal data: four base patterns, and information-theoretic sanitisation of the terms that give them away.

A protected entity is a distinct value of a base pattern, and so is each kind of them as a whole: that a text holds
somebody's card number is worth hiding as well as whose it is. Over the whole corpus, with documents as events, a
term t of the words around an entity e discloses the share PMI(e; t) / IC(e) of e's information content,
PMI = log2(p(e, t) / (p(e) p(t))), IC = -log2 p(e). A term is disclosing if, for some entity, that share is at
least `disclosure`, at least half of the documents with t have it beside e, and it stands beside e in at
least `support` different surroundings (copies of one passage count as one). Disclosing terms are generalised
to a placeholder of their shape, or removed where the share reaches `removal`.

Null texts are empty: they have no spans. Equal rows are treated alike, each for itself. In a corpus without
entities, and in an empty one, no term is disclosing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import add_columns, count_of, cut, table
from kinweave.llm.decontamination import merged, words

KINDS = ("email", "ip", "card", "phone", "term")
BASE = KINDS[:4]
#: Words on either side of an entity that count as its surroundings.
AROUND = 8
#: Different surroundings, share of an entity's information, and the share from which a term is removed.
SUPPORT, DISCLOSURE, REMOVAL = 3, 0.9, 0.98
#: Share of a term's documents that must have it beside the entity.
CONFIDENCE = 0.5
#: Terms that a task holds at once; more are looked for in several passes over the texts.
TERMS_AT_ONCE = 200_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = {c: c + 32 for c in range(65, 91)}


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ in turn: the run of local characters before it, and the domain behind it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    total += sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed, then by start. Linear in the text's length."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


class _Hidden:
    """Whether a stretch of text touches one of some spans."""

    def __init__(self, spans: list[tuple[int, int]]):
        runs = merged(spans)
        self.starts, self.ends = [a for a, _ in runs], [b for _, b in runs]

    def touches(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


def surroundings(text: str | None, around: int = AROUND) -> list[tuple[str, str, int]]:
    """(entity, term, surroundings' hash) for the words beside each base span, words of spans left out.

    An entity is named by its kind, a colon and its value.
    """
    spans = base_spans(text)
    if not spans:
        return []
    hidden = _Hidden([(a, b) for _, a, b in spans])
    out = []
    for kind, a, b in spans:
        width = 24
        while True:  # until enough words are in view, or all of the text is
            lo, hi = max(0, a - around * width), min(len(text), b + around * width)
            left = [m for m in _WORD.finditer(text, lo, a)]
            right = [m for m in _WORD.finditer(text, b, hi)]
            if (lo == 0 or len(left) > around) and (hi == len(text) or len(right) > around):
                break
            width *= 8
        near = [*left[-around:], *right[:around]]
        free = [m.group().translate(_FOLD) for m in near if not hidden.touches(m.start(), m.end())]
        entity = f"{kind}:{text[a:b].translate(_FOLD)}"
        mark = xxhash.xxh64_intdigest(" ".join(free)) - (1 << 63)
        out += [(entity, t, mark) for t in dict.fromkeys(free)]
    return out


def _lots(names: DataFrame, column: str, at_once: int) -> Iterator[list]:
    """The distinct values of a column in lists of at most `at_once`, one list on the driver at a time."""
    lot: list = []
    for r in names.select(column).distinct().toLocalIterator():
        lot.append(r[0])
        if len(lot) == at_once:
            yield lot
            lot = []
    if lot:
        yield lot


def disclosure(
    df: DataFrame,
    text: str = "text",
    around: int = AROUND,
    support: int = SUPPORT,
    confidence: float = 0.0,
    at_once: int = TERMS_AT_ONCE,
) -> DataFrame:
    """entity, term, both, with_entity, with_term and share for all terms of enough support and confidence.

    The numbers are of documents: with the term beside the entity, with the entity, with the term. The first pass
    over the corpus gathers the words beside entities; the second counts documents with the terms that have enough
    support, each task adding up its own before anything is shuffled.
    """

    def beside(texts: list) -> tuple[list, list]:
        found = [surroundings(t, around) for t in texts]
        return ([[{"entity": e, "term": t, "mark": m} for e, t, m in x] for x in found],)

    texts = df.select(F.col(text).alias("text"))
    near = add_columns(texts, ["text"], "near array<struct<entity:string,term:string,mark:long>>", beside)
    near = cut(near.filter(F.size("near") > 0).select(F.monotonically_increasing_id().alias("doc"), "near"))
    total = df.count()
    values = near.select("doc", F.explode("near").alias("x")).select("doc", "x.*")
    # A value's kind is an entity as well, named by the kind alone.
    kinds = F.explode(F.array("entity", F.substring_index("entity", ":", 1)))
    flat = values.select("doc", kinds.alias("entity"), "term", "mark")
    both = flat.groupBy("entity", "term").agg(
        F.count_distinct("mark").alias("marks"), F.count_distinct("doc").alias("both")
    )
    # Documents that have a term beside any entity are the least that can have it at all.
    least = values.groupBy("term").agg(F.count_distinct("doc").alias("beside_any"))
    both = both.filter(F.col("marks") >= support).join(least, "term")
    both = cut(both.filter(F.col("both") >= F.lit(confidence) * F.col("beside_any")))
    having = flat.select("entity", "doc").distinct().groupBy("entity").agg(F.count("doc").alias("with_entity"))
    counts = None
    for lot in _lots(both, "term", at_once):
        held = df.sparkSession.sparkContext.broadcast(frozenset(t.encode() for t in lot))

        def present(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    seen.update(held.value.intersection(words(t)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([t.decode() for t in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
                names=["term", "n"],
            )

        own = texts.mapInArrow(present, "term string, n long")
        own = own.groupBy("term").agg(F.sum("n").alias("with_term"))
        counts = own if counts is None else counts.union(own)
    if counts is None:
        counts = both.select("term", F.col("both").alias("with_term"))
    share = F.when(F.col("with_entity") >= total, F.lit(0.0)).otherwise(
        F.lit(1.0)
        - F.greatest(F.log2(F.col("with_term") / F.col("both")), F.lit(0.0))
        / F.log2(F.lit(float(total)) / F.col("with_entity"))
    )
    joined = both.join(having, "entity").join(counts, "term").withColumn("share", share)
    return joined.filter(F.col("both") >= F.lit(confidence) * F.col("with_term")).select(
        "entity", "term", "both", "with_entity", "with_term", "share"
    )


def disclosing_terms(
    df: DataFrame,
    text: str = "text",
    around: int = AROUND,
    support: int = SUPPORT,
    least_share: float = DISCLOSURE,
    confidence: float = CONFIDENCE,
    at_once: int = TERMS_AT_ONCE,
) -> DataFrame:
    """term and share (the largest over entities) of the disclosing terms, a table in the shared folder."""
    found = disclosure(df, text, around, support, confidence, at_once).filter(F.col("share") >= least_share)
    return cut(found.groupBy("term").agg(F.max("share").alias("share")))


def find_personal_data(
    df: DataFrame, text: str = "text", at_once: int = TERMS_AT_ONCE, clean: str | None = None, **thresholds
) -> DataFrame:
    """df with spans array<struct<kind,start,end,share>>: base spans and disclosing terms outside of them.

    Every other column is kept. `share` is null for base spans. `clean` names a further column, of the sanitised
    text, which is made in the same pass.
    """
    found = disclosing_terms(df, text, at_once=at_once, **thresholds)
    fields = "spans array<struct<kind:string,start:long,end:long,share:double>>"
    fields += f", `{clean}` string" if clean else ""

    def spans_of(texts: list, held, before: list | None) -> tuple[list, ...]:
        shares, out = held.value if held is not None else {}, []
        known = frozenset(t.encode() for t in shares)
        for i, t in enumerate(texts):
            if before is None:
                spans = [{"kind": k, "start": a, "end": b, "share": None} for k, a, b in base_spans(t)]
            else:
                spans = list(before[i])
            if known and not known.isdisjoint(words(t)):
                hidden = _Hidden([(s["start"], s["end"]) for s in spans])
                for m in _WORD.finditer(t):
                    share = shares.get(m.group().translate(_FOLD))
                    if share is not None and not hidden.touches(m.start(), m.end()):
                        spans.append({"kind": "term", "start": m.start(), "end": m.end(), "share": share})
            out.append(sorted(spans, key=lambda s: (KINDS.index(s["kind"]), s["start"])))
        return (out, list(map(sanitised, texts, out))) if clean else (out,)

    done = None
    spark = df.sparkSession
    for lot in _lots(found.select(F.struct("term", "share").alias("x")), "x", at_once):
        held = spark.sparkContext.broadcast({r["term"]: r["share"] for r in lot})
        if done is None:
            done = add_columns(df, [text], fields, lambda texts, held=held: spans_of(texts, held, None))
        else:
            done = add_columns(cut(done), [text, "spans"], fields, lambda texts, b, held=held: spans_of(texts, held, b))
    return done if done is not None else add_columns(df, [text], fields, lambda texts: spans_of(texts, None, None))


def sanitised(text: str | None, spans: list, removal: float = REMOVAL) -> str | None:
    """text with every span replaced: [EMAIL] and so on; a term by [NUMBER] or [WORD], or by nothing."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        a, b = s["start"], s["end"]
        if b <= at:
            continue
        out.append(text[at : max(a, at)])
        if a >= at:
            if s["kind"] != "term":
                out.append(f"[{s['kind'].upper()}]")
            elif s["share"] < removal:
                out.append("[NUMBER]" if text[a:b].isdigit() else "[WORD]")
        at = b
    out.append(text[at:])
    return "".join(out)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and a digest of the base spans, and all spans."""
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.transform(F.filter("spans", lambda s: s["kind"].isin(*BASE)), said)
    return found.select(
        "doc_id",
        *(count_of(k).alias(f"n_{k}") for k in BASE),
        count_of("term").alias("n_term"),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", said), ",").alias("spans"),
    )


def stage_sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with sanitised texts; n_chars follows the text where it is one of the columns."""
    done = find_personal_data(docs, clean="__clean")
    own = {"text": F.col("__clean").alias("text"), "n_chars": F.char_length("__clean").cast("long").alias("n_chars")}
    return done.select(*(own.get(c, F.col(c)) for c in docs.columns))
