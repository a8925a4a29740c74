"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong spans stand on their own: ``assign`` (a labelled value), ``access`` (an
access identifier) and ``hex`` (a long hexadecimal run).  Weak candidates are
reported only when complementary parts co-occur in their scope, which is
``scope`` code points to either side within the document:

* ``key_id``, a labelled account or client identifier (in either case): beside a secret
  (assign, hex or a weak secret),
* ``secret``, an unlabelled run of 32 or more with upper and lower case and a
  digit: beside an identifier (access or key_id),
* ``endpoint``, a URL host: beside both an identifier and a secret.

Candidates and parts are interval-joined on document and position buckets.  A
candidate inside a strong span adds nothing and is left out.

Positions are code points, end exclusive: a match starts after the pieces and
matches before it, a running sum over the matches of a document and kind.

Null texts count as empty.  Documents are told apart by id and a hash of the
text, so null ids, repeated ids and repeated rows each keep their own result.
Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import text_or_empty, write_table

# Fixed values of the query contract: strong kinds in their order.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 or more: a run's first match is its longest
HEX = r"[0-9a-f]{24,}"  # [0-9a-f]+ of 24 or more
MIN_VALUE = 6

KEY_ID = r"""(?i:(?:access|account|client|app)[_-]?(?:key[_-]?)?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_-]{8,}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{32,}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+"

STRONG = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
WEAK = {"key_id": KEY_ID, "secret": WEAK_SECRET, "endpoint": ENDPOINT}
KINDS = [*STRONG, *WEAK]
SCOPE = 400


def match_steps(text: Column, pattern: str, keep_group: int = 0) -> Column:
    """Array of (gap before the match, its length, whether it counts)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.arrays_zip(
        F.transform(F.slice(gaps, 1, F.size(found)), lambda g: F.char_length(g)).alias("gap"),
        F.transform(found, lambda m: F.char_length(m)).alias("len"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(keep_group)),
                    lambda g: F.char_length(g) >= F.lit(MIN_VALUE if keep_group else 0)).alias("ok"))
    return F.when(text.rlike(pattern), lengths)


def found_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows doc_id, mark (hash of the text) and a column of match steps per kind."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    steps = [match_steps(F.col("text"), p, 2 if k == "assign" else 0).alias(k) for k, p in {**STRONG, **WEAK}.items()]
    return rows.select("doc_id", F.xxhash64("text").alias("mark"), *steps)


def located(found: DataFrame) -> DataFrame:
    """All spans and candidates: doc_id, mark, kind (its number), start, end."""
    each = F.array_compact(F.array(*[
        F.when(F.col(k).isNotNull(), F.struct(F.lit(i).alias("kind"), F.col(k).alias("steps"))) for i, k in enumerate(KINDS)]))
    rows = found.where(F.coalesce(*KINDS).isNotNull()).dropDuplicates(["doc_id", "mark"])
    rows = rows.select("doc_id", "mark", F.explode(each).alias("e")).select(
        "doc_id", "mark", "e.kind", F.posexplode("e.steps").alias("at", "step"))
    upto = Window.partitionBy("doc_id", "mark", "kind").orderBy("at")
    end = F.sum(F.col("step.gap") + F.col("step.len")).over(upto)
    return rows.select("doc_id", "mark", "kind", "step.ok", "step.len", end.cast("long").alias("end")).where("ok").select(
        "doc_id", "mark", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def linked_candidates(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak candidates that have their complementary parts in scope."""
    number = {k: i for i, k in enumerate(KINDS)}
    weak = spans.where(F.col("kind") >= len(STRONG)).select(
        "doc_id", "mark", "kind", "start", "end",
        F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))).alias("bucket"))
    # a part sits in every bucket it reaches into; a pair meeting in several counts once, as only "any" is asked
    parts = spans.select(F.col("doc_id").alias("p_doc"), F.col("mark").alias("p_mark"), F.col("kind").alias("p_kind"),
                         F.col("start").alias("p_start"), F.col("end").alias("p_end"),
                         F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("p_bucket"))
    near = (F.col("p_start") <= F.col("end") + scope) & (F.col("start") <= F.col("p_end") + scope)
    other = (F.col("p_kind") != F.col("kind")) | (F.col("p_start") != F.col("start"))
    met = weak.join(parts, weak["doc_id"].eqNullSafe(parts["p_doc"]) & (weak["mark"] == parts["p_mark"]) & (weak["bucket"] == parts["p_bucket"]) & near & other)
    overlap = (F.col("p_start") < F.col("end")) & (F.col("start") < F.col("p_end"))
    strong = F.col("p_kind") < len(STRONG)
    ident = F.col("p_kind").isin(number["access"], number["key_id"]) & ~overlap
    hidden = F.col("p_kind").isin(number["assign"], number["hex"], number["secret"]) & ~overlap
    seen = met.groupBy("doc_id", "mark", "kind", "start", "end").agg(
        F.max(ident).alias("ident"), F.max(hidden).alias("hidden"), F.max(strong & overlap).alias("covered"))
    complete = (F.when(F.col("kind") == number["key_id"], F.col("hidden"))
                .when(F.col("kind") == number["secret"], F.col("ident")).otherwise(F.col("ident") & F.col("hidden")))
    return seen.where(complete & ~F.col("covered")).select("doc_id", "mark", "kind", "start", "end")


def joined_spans(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    found = write_table(found_spans(docs, id_col, text_col), "secret_steps")
    spans = write_table(located(found), "secret_spans")
    linked = linked_candidates(spans, scope)
    reported = spans.where(F.col("kind") < len(STRONG)).unionByName(linked)
    span = F.struct("start", "kind", "end")
    listed = write_table(reported.groupBy("doc_id", "mark").agg(F.collect_list(span).alias("all")), "secret_lists")
    rows = found.select("doc_id", "mark")
    rows = rows.join(listed.withColumnsRenamed({"doc_id": "l_doc", "mark": "l_mark"}),
                     F.col("doc_id").eqNullSafe(F.col("l_doc")) & (F.col("mark") == F.col("l_mark")), "left")
    every = F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    base = F.filter(every, lambda s: s["kind"] < len(STRONG))

    def count(i: int) -> Column:
        return F.size(F.filter(every, lambda s: s["kind"] == i)).cast("long")

    return rows.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(STRONG)], F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(every).alias("spans"),
                       (F.size(every) - F.size(base)).cast("long").alias("n_linked"))
