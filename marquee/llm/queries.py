"""The registered queries of the numbered operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import collocations, language, media, neardup, packing, pieces, quality, rules, secrets, sharding, toxicity, warc, whitening
from marquee.llm.common import fold


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = rules.fit(docs, table(spark, sf_dir, "labels"), "quality")
    out = rules.apply_rules(docs.select("doc_id", "text"), learned)
    return out.select("doc_id", *(f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(fold("doc_id", 4) != 2))
    rows = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "text")
    return language.identify(rows, model, keep=["doc_id", "held_out"]).withColumnRenamed("lang_score", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = toxicity.fit(docs, labels.where(fold("doc_id", 5) != 0), "toxic")
    rows = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text")
    return toxicity.predicted(toxicity.score(rows, weights, keep=["doc_id", "held_out"]), 0.5)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), digests=True)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = warc.write_archives(table(spark, sf_dir, "pages"))
    records = warc.read_archives(warc.merge_index(runs))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(fold("doc_id", 5) != 0), "quality")
    rows = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text")
    return toxicity.predicted(quality.score(rows, model, keep=["doc_id", "held_out"]), 0.3)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = media.images_of(table(spark, sf_dir, "embeddings"))
    n = len(media.CHANGES)
    change = F.element_at(F.array(*[F.lit(c) for c in media.CHANGES]), (F.pmod("image_id", F.lit(n)) + 1).cast("int"))
    return media.copies(images, "image_id").select("image_id", ((F.col("image_id") - F.pmod("image_id", F.lit(n))) / n).cast("long").alias("vec_id"), F.when(F.col("image_id").isNull(), media.CHANGES[0]).otherwise(change).alias("change"), "n_corners", "n_links", "group_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and the base rule of op2, which SQL can express; no rule is learned."""
    out = rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), [])
    return out.select("doc_id", *(f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed")


def base_span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many base spans op6 finds, which SQL can express; nothing is judged by its novelty."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"], redact=False, novel=False)
    return found.select("doc_id", *(f"found.{c}" for c in ("n_assign", "n_access", "n_hex")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_rules": op2_rules,
    "op3_language": op3_language,
    "op4_pieces": op4_pieces,
    "op5_toxicity": op5_toxicity,
    "op6_secrets": op6_secrets,
    "op7_warc": op7_warc,
    "op8_neardup": op8_neardup,
    "op9_quality": op9_quality,
    "op10_media": op10_media,
    "op11_collocations": op11_collocations,
    "op12_sharding": op12_sharding,
    "op13_whitening": op13_whitening,
    "text_statistics": text_statistics,
    "base_span_counts": base_span_counts,
}

_WORDS = r"[w FOR w IN regexp_split_to_array({text}, '[\x20\x09-\x0D]+') IF w <> '']"

ORACLES: dict[str, str] = {
    "text_statistics": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
        w AS (SELECT *, {_WORDS.format(text="text")} AS words, [l FOR l IN string_split(text, chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines FROM d),
        five AS (SELECT row, i, array_to_string(words[i : i + 4], ' ') AS run FROM w, unnest(range(1, len(words) - 3)) AS t(i)),
        twice AS (SELECT row, i FROM five QUALIFY count(*) OVER (PARTITION BY row, run) > 1),
        covered AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) AS t(k) GROUP BY 1)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
               CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
               coalesce(n, 0) AS n_repeat_words, len(words) < 10 OR 100 * coalesce(n, 0) > 20 * len(words) AS base_failed
        FROM w LEFT JOIN covered USING (row)
    """,
    "base_span_counts": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id,
               CAST(len([x FOR x IN regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) IF length(x) >= 6]) AS BIGINT) AS n_assign,
               CAST(len([x FOR x IN regexp_extract_all(text, 'AKIA[A-Z0-9]+') IF length(x) >= 20]) AS BIGINT) AS n_access,
               CAST(len([x FOR x IN regexp_extract_all(text, '[0-9a-f]+') IF length(x) >= 24]) AS BIGINT) AS n_hex
        FROM d
    """,
    "op8_neardup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(words) < 2 THEN words ELSE list_sort(list_distinct([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))])) END AS items FROM w),
        c AS (SELECT items, min(doc_id) AS rep, len(items) AS n FROM s WHERE len(items) > 0 GROUP BY 1),
        u AS (SELECT rep, n, unnest(items) AS item FROM c),
        p AS (SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.item = b.item AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
              GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        r AS (SELECT rep AS id, rep AS root FROM c UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
        parts AS (SELECT id, min(root) AS component FROM r GROUP BY 1),
        o AS (SELECT s.doc_id, CAST(len(s.items) AS BIGINT) AS n_shingles, coalesce(component, s.doc_id) AS component_id FROM s LEFT JOIN c USING (items) LEFT JOIN parts ON id = c.rep)
        SELECT *, doc_id = component_id AS kept FROM o
    """,
    "op11_collocations": r"""
        WITH t AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
        w AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS words FROM p),
        total AS (SELECT lang, sum(len(words)) AS n FROM w GROUP BY 1),
        g AS (SELECT lang, words[i : i + k - 1] AS words FROM w, unnest(range(1, 6)) AS s(k), unnest(range(1, len(words) - k + 2)) AS q(i)),
        f AS (SELECT lang, words, array_to_string(words, ' ') AS phrase, len(words) AS k, count(*) AS a FROM g GROUP BY 1, 2 HAVING count(*) >= 100),
        c AS (SELECT * FROM f WHERE k > 1),
        inside AS (SELECT DISTINCT c.lang, array_to_string(c.words[i : i + j - 1], ' ') AS phrase, c.a FROM c, unnest(range(2, k)) AS s(j), unnest(range(1, k - j + 2)) AS q(i)),
        kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a)),
        cut AS (SELECT lang, phrase, a, cut, array_to_string(words[1 : cut], ' ') AS one, array_to_string(words[cut + 1 : ], ' ') AS two FROM kept, unnest(range(1, k)) AS s(cut)),
        scored AS (SELECT cut.lang, cut.phrase, cut.a, cut, x.a AS l, y.a AS r, n, (CAST(1000 AS HUGEINT) * cut.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS score
              FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = one JOIN f y ON y.lang = cut.lang AND y.phrase = two JOIN total ON total.lang = cut.lang),
        least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
        SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM ranked WHERE rank <= 2000
    """,
    "op12_sharding": """
        WITH RECURSIVE step(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM step WHERE k < 8),
        t AS (SELECT list(c ORDER BY i) AS crc FROM step WHERE k = 8),
        b AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS hex FROM documents),
        e AS (SELECT *, list_prepend(4294967295, [CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex, '..')]) AS bytes FROM b),
        d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS stratum, length(hex) // 2 + 1 AS size,
              xor(list_reduce(bytes, lambda a, x: xor(a // 256, crc[xor(a, x) % 256 + 1])), 4294967295) AS text_crc32 FROM e, t),
        h AS (SELECT *, CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || text_crc32), 1, 15) AS BIGINT) AS draw,
              CAST('0x' || substr(md5('7|' || stratum), 1, 13) AS BIGINT) / 4503599627370496.0 AS shift FROM d),
        r AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY draw, doc_id, text_crc32, size) - 1 + shift) / count(*) OVER (PARTITION BY stratum) AS part FROM h),
        p AS (SELECT *, row_number() OVER (ORDER BY part, stratum, draw, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS n FROM r),
        s AS (SELECT *, CAST(place * 8 // n AS INTEGER) AS shard FROM p)
        SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, shard, CAST(place - (shard * n + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
    """,
    "op7_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
            FROM pages
        ), w AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS response FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> response THEN response END AS refers_to
        FROM w
    """,
}
