"""The registered queries of this subpackage and their oracle SQL.

Each takes ``(spark, sf_dir)`` and applies its operator with production
parameters to the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import WORD, read, text_or_empty
from quadrille.llm.conversation_trie import spliced, trie_of, turn_keys
from quadrille.llm.decontamination import decontaminate
from quadrille.llm.exact_dedup import exact_dedup
from quadrille.llm.jaccard_join import jaccard_join
from quadrille.llm.mixing import mix
from quadrille.llm.periodic_runs import periodic_runs
from quadrille.llm.secret_scan import scan_secrets
from quadrille.llm.substring_dedup import repeated_units
from quadrille.llm.token_counts import token_counts
from quadrille.llm.token_output import token_output
from quadrille.llm.toxicity import toxicity
from quadrille.llm.url_filters import filter_urls
from quadrille.llm.warc import deduplicate, read_archives, records_of


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = deduplicate(records_of(read(spark, sf_dir, "pages")), min_bytes=0)
    return read_archives(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(read(spark, sf_dir, "documents"), units="passages").drop("mark")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")  # a page's labels are those of its id
    blocked = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    return filter_urls(read(spark, sf_dir, "pages"), blocked)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents")).drop("n_linked")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).drop("n_bytes")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_output(read(spark, sf_dir, "documents"), path).drop("path")


def looped(docs: DataFrame) -> DataFrame:
    """Documents whose id has a CRC of h, h % 10 = 0, go round in a loop: from word a on,
    word i is word a + (i - a) % p.  Other texts, also those of a null id, stay."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, words = F.floor(h / 10).cast("long"), F.regexp_extract_all(text_or_empty(), F.lit(f"({WORD})"))
    docs = docs.select("doc_id", "text", g.alias("g"), F.when((h % 10 == 0) & (F.size(words) > 0), words).alias("w"))
    n = F.size("w")
    a = (F.col("g") % n).cast("int")
    docs = docs.select("doc_id", "text", "w", n.alias("n"), a.alias("a"), F.floor(1 + (n - a) / (3 + F.col("g") % 8)).cast("int").alias("p"))
    loop = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return docs.select("doc_id", F.when(F.col("w").isNotNull(), F.array_join(loop, " ")).otherwise(F.col("text")).alias("text"))


#: Greater length / period first, then smaller start, then smaller period.
BEST = """element_at(array_sort(runs, (x, y) -> CASE WHEN x.length * y.period <> y.length * x.period THEN IF(x.length * y.period > y.length * x.period, -1, 1)
  WHEN x.start <> y.start THEN IF(x.start < y.start, -1, 1) ELSE IF(x.period < y.period, -1, 1) END), 1)"""


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(looped(read(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.when(F.size("runs") > 0, F.expr(BEST))
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("conv_id")
    return trie_of(spliced(turn_keys(read(spark, sf_dir, "conversations")), F.crc32(own.cast("string")) % 9, 8, own - own % 5))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_url_filters": op6_url_filters,
    "op7_secret_scan": op7_secret_scan,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mixing": op9_mixing,
    "op10_token_output": op10_token_output,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_token_counts": op13_token_counts,
}

NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

#: Shingle sets, all pairs that share a shingle, and the smallest id within reach.
JACCARD_SQL = r"""
  WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
  s AS (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                              ELSE list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END) AS g FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  rare AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
  r AS (SELECT s.doc_id, s.g FROM s JOIN rare ON s.g = rare.g),
  both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM r x JOIN r y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
  FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id"""

#: Sentences of lines, with offsets by running sums of lengths and the number of the paragraph.
SENTENCES_SQL = r"""
  WITH l0 AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
  l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln FROM l0),
  p0 AS (SELECT doc_id, ln, string_split(line, '. ') AS ps, sum(regexp_full_match(line, '\s*')::INT) OVER (PARTITION BY doc_id ORDER BY ln) AS paragraph,
           coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS here FROM l),
  p AS (SELECT doc_id, ln, paragraph, here, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pn FROM p0),
  u AS (SELECT doc_id, paragraph, piece, CAST(here + coalesce(sum(length(piece) + 2) OVER (
           PARTITION BY doc_id, ln ORDER BY pn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM p),
  n AS (SELECT doc_id, paragraph, start, start + length(piece) AS "end",
           trim(regexp_replace(regexp_replace(lower(piece), '\.$', ''), '\s+', ' ', 'g')) AS norm FROM u),
  w AS (SELECT *, length(norm) - length(replace(norm, ' ', '')) + 1 AS words FROM n)"""

#: Sentences of at least 8 words (``units="sentences"``).
UNITS_SQL = SENTENCES_SQL + """,
  k AS (SELECT *, min(doc_id) OVER (PARTITION BY norm) AS keep_doc_id,
           row_number() OVER (PARTITION BY doc_id, norm ORDER BY start) AS nth FROM w WHERE words >= 8)
  SELECT doc_id, start, "end", words, keep_doc_id FROM k WHERE nth > 1 OR doc_id <> keep_doc_id"""

#: Shortest runs of sentences that hold 8 words from or up to each, and whole paragraphs of as many.
PASSAGES_SQL = SENTENCES_SQL + """,
  s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS i, sum(words) OVER (PARTITION BY doc_id ORDER BY start) AS upto
        FROM w WHERE norm <> ''),
  runs AS (SELECT a.doc_id, a.i, b.i AS j FROM (SELECT *, unnest(range(8)) AS more FROM s) a JOIN s b ON b.doc_id = a.doc_id AND b.i = a.i + a.more
           WHERE b.upto - a.upto + a.words >= 8 AND (b.upto - b.words - a.upto + a.words < 8 OR b.upto - a.upto < 8)
           UNION SELECT doc_id, min(i), max(i) FROM s GROUP BY doc_id, paragraph HAVING sum(words) >= 8),
  k AS (SELECT r.doc_id, min(s.start) AS start, max(s."end") AS "end", sum(s.words)::BIGINT AS words, string_agg(s.norm, ' ' ORDER BY s.i) AS norm
        FROM (SELECT *, unnest(range(i, j + 1)) AS at FROM runs) r JOIN s ON s.doc_id = r.doc_id AND s.i = r.at GROUP BY r.doc_id, r.i, r.j),
  f AS (SELECT *, min(doc_id) OVER (PARTITION BY norm) AS keep_doc_id,
           first_value("end") OVER (PARTITION BY doc_id, norm ORDER BY start) AS first_end FROM k)
  SELECT doc_id, start, "end", words, keep_doc_id FROM f WHERE start >= first_end OR doc_id <> keep_doc_id"""

#: CRC-32 of the decimal conv_id, bit by bit.
CRC_SQL = """xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

#: All prefixes of all rebuilt conversations, grouped; each node's row joined to all nodes above it.
TRIE_SQL = f"""
  WITH t AS (SELECT conv_id, list(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) || strlen(coalesce(text, ''))
                                  ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts
             FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
  h AS (SELECT *, {CRC_SQL} % 9 AS h FROM t),
  r AS (SELECT h.conv_id, coalesce(b.ts[:h.h], []) || h.ts[h.h + 1:] AS ts FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 5),
  p AS (SELECT conv_id, len(ts) AS n, d, sha256(array_to_string(ts[:d], ',')) AS k, sha256(array_to_string(ts[:d - 1], ',')) AS up,
               CASE WHEN d = 0 THEN 0 ELSE substr(ts[d], 65)::BIGINT END AS bytes
        FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM r)),
  g AS (SELECT k, d, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = d AS leaf, (count(*) - 1) * min(bytes) AS saved,
               sha256(coalesce(string_agg(CASE WHEN n = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM p GROUP BY k, d),
  kids AS (SELECT up, count(*) AS n FROM g WHERE d > 0 GROUP BY up),
  above AS (SELECT a.k AS top, p.k, p.d FROM g JOIN p ON p.conv_id = g.conv_id AND p.d = g.d JOIN p a ON a.conv_id = g.conv_id AND a.d <= g.d),
  under AS (SELECT above.top, sum(g.leaf::INT)::BIGINT AS n_leaves, sum(g.saved)::BIGINT AS saved_tokens FROM above JOIN g ON g.k = above.k AND g.d = above.d GROUP BY above.top)
  SELECT g.conv_id, g.d::BIGINT AS depth, o.conv_id AS parent_conv_id, g.n_convs, coalesce(kids.n, 0) AS n_children, under.n_leaves, under.saved_tokens, g.ends_sha256
  FROM g JOIN under ON under.top = g.k LEFT JOIN g o ON o.k = g.up AND o.d = g.d - 1 LEFT JOIN kids ON kids.up = g.k"""

ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": PASSAGES_SQL,
    "op5_jaccard_join": JACCARD_SQL,
    "op8_exact_dedup": f"""
  WITH n AS (SELECT doc_id, {NORMAL} AS t FROM documents),
  g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
  SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
  FROM n JOIN g ON n.t = g.t""",
    "op12_conversation_trie": TRIE_SQL,
}
