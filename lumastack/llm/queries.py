"""The thin queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_fst import code_digests
from .html_tree import main_texts
from .lexical import ranked_search
from .line_rules import line_rules
from .mixing import mix, taken_words
from .near_dup import near_duplicates
from .phrases import phrases
from .pii import personal_data
from .quality_qda import quality_scores
from .records import record_digests
from .sketch import fingerprints
from .token_scan import counted
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return main_texts(_table(spark, sf_dir, "pages"))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written as binary records in ascending doc_id order, and read back."""
    return record_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document in the mix of all sources, weighted 1, 2, 3 in turn and capped at three times their size."""
    return taken_words(mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def op4_semi_markov_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return personal_data(_table(spark, sf_dir, "documents"))


def op5_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the rank file's merges and decoded again."""
    return code_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, compared with each other and with the next document's."""
    return fingerprints(_table(spark, sf_dir, "documents"))


def op8_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules; lines that many texts of a source share are removed, and documents that they deplete rejected."""
    docs = _table(spark, sf_dir, "documents")
    return line_rules(docs.select("doc_id", "text", docs["source"].alias("host")))


def op9_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups on distinct 4-word shingles, Jaccard at least 0.8."""
    return near_duplicates(_table(spark, sf_dir, "documents"), k=4, num=80, den=100)


def op10_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from flat files of word ids."""
    return counted(_table(spark, sf_dir, "documents"))


def op11_phrase_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of two and three words in all documents, by language."""
    return phrases(_table(spark, sf_dir, "documents"))


def op12_linear_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, and their toxic spans as start:end, comma-joined."""
    out = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ","))


def op13_stratified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_style_tree": op1_style_tree,
    "op2_token_records": op2_token_records,
    "op3_weighted_mix": op3_weighted_mix,
    "op4_semi_markov_crf": op4_semi_markov_crf,
    "op5_quadratic_discriminant": op5_quadratic_discriminant,
    "op6_bpe_transducer": op6_bpe_transducer,
    "op7_scaled_sketch": op7_scaled_sketch,
    "op8_line_frequency": op8_line_frequency,
    "op9_superminhash": op9_superminhash,
    "op10_separator_scan": op10_separator_scan,
    "op11_phrase_tries": op11_phrase_tries,
    "op12_linear_chain": op12_linear_chain,
    "op13_stratified_search": op13_stratified_search,
}

SQL: dict[str, str] = {
    "op10_separator_scan": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents)
        SELECT doc_id, row_number() OVER w - 1 AS ordinal, CAST(sum(n + 1) OVER w - n - 1 AS BIGINT) AS start, n AS n_tokens
        FROM d WINDOW w AS (ORDER BY doc_id NULLS FIRST, t ROWS UNBOUNDED PRECEDING)
    """,
    "op11_phrase_tries": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
        q AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        g AS (SELECT lang, size, array_to_string(ws[i : i + size - 1], ' ') AS phrase
              FROM (SELECT lang, ws, size, unnest(range(1, CAST(len(ws) AS BIGINT) - size + 2)) AS i FROM q, (SELECT unnest([1, 2, 3]) AS size) WHERE len(ws) >= size)),
        f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY 1, 2, 3),
        n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY 1),
        c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND a >= 10),
        cuts AS (SELECT c.*, k, array_to_string(ws[1 : k], ' ') AS head, array_to_string(ws[k + 1 :], ' ') AS rest FROM c, (SELECT unnest([1, 2]) AS k) WHERE k < size),
        s AS (SELECT cuts.lang, cuts.size, cuts.phrase, cuts.a, k, h.a AS l, r.a AS r,
                     CAST((1000000 * CAST(cuts.a AS HUGEINT) * cuts.a) // (CAST(h.a AS HUGEINT) * r.a) AS BIGINT) AS score
              FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f r ON r.lang = cuts.lang AND r.phrase = rest),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inside AS (SELECT lang, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase, a FROM c WHERE size = 3),
        longer AS (SELECT lang, phrase, max(a) AS m FROM inside GROUP BY 1, 2),
        kept AS (SELECT b.* FROM b LEFT JOIN longer x ON x.lang = b.lang AND x.phrase = b.phrase AND b.size = 2 WHERE x.m IS NULL OR 100 * x.m < 50 * b.a)
        SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n AS n, score
        FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= 2000
    """,
    "op13_stratified_search": r"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
        sizes AS (SELECT row, doc_id, CAST(len(ws) AS BIGINT) AS n FROM d WHERE len(ws) > 0),
        t AS (SELECT count(*) AS n_docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM sizes),
        post AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(ws) AS term FROM d) GROUP BY 1, 2),
        items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM post, t GROUP BY term, n_docs),
        m AS (SELECT row, doc_id, 50 + CAST((50 * CAST(n AS HUGEINT) * n_docs) // total AS BIGINT) AS m FROM sizes, t),
        s AS (SELECT i.item_id, m.row, m.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
              FROM items i JOIN post p ON p.term = i.term JOIN w ON w.term = i.term JOIN m ON m.row = p.row GROUP BY 1, 2, 3)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 50
    """,
    "op8_line_frequency": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS host FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
        win AS (SELECT doc_id, i, hash(ws[i], ws[i+1], ws[i+2], ws[i+3], ws[i+4]) AS h
                FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
        twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS c FROM win) WHERE c > 1),
        rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY 1),
        texts AS (SELECT DISTINCT host, t FROM d),
        lines AS (SELECT host, t, regexp_replace(trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g') AS line,
                         len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS nw
                  FROM (SELECT host, t, unnest(string_split(t, chr(10))) AS l FROM texts) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
        sizes AS (SELECT host, count(*) AS n_texts FROM texts GROUP BY 1),
        freq AS (SELECT l.host, line FROM (SELECT host, line, count(DISTINCT t) AS n FROM lines GROUP BY 1, 2) l JOIN sizes s ON s.host = l.host
                 WHERE n > 5 AND (100 * n > 8 * n_texts OR n > 1000)),
        cut AS (SELECT l.host, t, sum(nw) AS removed FROM lines l JOIN freq f ON f.host = l.host AND f.line = l.line GROUP BY 1, 2),
        s AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                     CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                     CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, w.host, t
              FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND 100 * coalesce(removed, 0) <= 70 * n_words AND n_words - coalesce(removed, 0) >= 10 AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed_words
        FROM b LEFT JOIN cut ON cut.host = b.host AND cut.t = b.t
    """,
}
