"""One query for each training-data operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.llm import decontaminate, exact_dedup, language_id, licenses, middle, mixing, quality, runs, simhash, token_counts, token_files, url_filter, warc
from logmill.llm.common import WORD, shared_dir, stored, table
from logmill.session import ship

TOKENIZER = "piece_bpe_32k.model"
BYTE_TOKENIZER, END_ID = "byte_bpe_50k.json", 2


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(ship(spark), sf_dir, "documents"))


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(ship(spark), table(spark, sf_dir, "pages"), shared_dir(spark))
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")  # noqa: E731  behind urn:page:
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "problem")


def op3_token_counts(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, Path(model or tokenizer_path()).read_bytes())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(ship(spark), sf_dir, "documents").select("doc_id", "text")).drop("detections")


def op6_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(ship(spark), sf_dir, "documents"))


def op7_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words().alias("size"))
    sized = stored(docs, f"{shared_dir(spark)}/sizes")  # texts are read once
    return mixing.mix(sized, text=None).select("doc_id", "size", "source_size", "target", "taken")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "first_word", "n_words")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.transform(table(ship(spark), sf_dir, "documents").select("doc_id", "text"))
    return middle.restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op12_token_files(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    path = f"{shared_dir(ship(spark))}/ids"
    token_files.write(table(spark, sf_dir, "documents"), Path(model or tokenizer_path(BYTE_TOKENIZER)).read_text(), path, END_ID)
    return token_files.with_checksum(token_files.read(spark, path))


def with_loops(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the words of a tenth of the texts (by crc32 of doc_id) going round from some word on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    looped = docs.where(h % 10 == 0).select("doc_id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"), F.floor(h / 10).alias("g"), "text").withColumn("n", F.size("w"))
    looped = looped.withColumn("a", F.when(F.col("n") > 0, F.expr("int(g % n)"))).withColumn("p", F.expr("int(1 + floor((n - a) / (3 + g % 8)))"))
    tail = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), int(ceil((n - a) / p)))), 1, n - a)")
    looped = looped.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.expr("slice(w, 1, a)"), tail), " ")).otherwise(F.col("text")).alias("text"))
    return docs.where(h % 10 != 0).select("doc_id", "text").union(looped)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(with_loops(table(ship(spark), sf_dir, "documents")))
    best = F.expr("aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_warc_archives, op3_token_counts, op4_quality, op5_license_scan, op6_simhash_bktree, op7_fair_mix, op8_exact_dedup, op9_url_filter, op10_decontaminate, op11_fill_in_middle, op12_token_files, op13_periodic_runs, pipeline)
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_archives": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS keep FROM p)
        SELECT page_id, payload_bytes,
            list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN keep IS NULL OR keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN keep <> page_id OR page_id IS NULL THEN keep END AS refers_to, CAST(NULL AS VARCHAR) AS problem
        FROM d""",
    "op7_fair_mix": """
        WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
        v AS (SELECT *, 3 * source_size AS cap,
                CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                / sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
        t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(max(CASE WHEN level <= cap / w THEN level END) OVER (), 0.0) * w) AS target FROM v),
        p AS (SELECT d.doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS cut,
                CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, greatest(0, least(size, cut - pos)) + greatest(0, least(size, cut - pos - source_size)) + greatest(0, least(size, cut - pos - 2 * source_size)) AS taken FROM p""",
    "op8_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, sha256(t) AS text_sha256,
                row_number() OVER (PARTITION BY t, doc_id) AS copy FROM n WINDOW w AS (PARTITION BY t))
        SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id) AND copy = 1 AS kept, text_sha256 FROM g""",
    "op9_url_filter": """
        WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        rules(rule, said) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
        r AS (SELECT p.*, (SELECT max(struct_pack(n := len(rule), rule := rule, said := said)) FROM rules
                WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))) AS hit FROM p),
        l AS (SELECT page_id, host, path, hit.rule AS rule, hit.said AS said, CASE WHEN hit.said = 'block' THEN 1 WHEN hit.said IS NOT NULL THEN 0 END AS bad,
                array_to_string(split(host, '.')[-1:], '.') AS s1, array_to_string(split(host, '.')[-2:], '.') AS s2, array_to_string(split(host, '.')[-3:], '.') AS s3 FROM r),
        h AS (SELECT host, CASE WHEN two THEN s2 ELSE s1 END AS suffix, CASE WHEN two THEN s3 ELSE s2 END AS domain, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS k
              FROM (SELECT *, s2 IN ('ac.uk', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'co.za', 'com.ar', 'com.au', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'gov.uk', 'ne.jp', 'or.jp', 'org.au', 'org.uk') AS two FROM l) GROUP BY ALL),
        d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
        s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
        top AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m, coalesce(sum(n), 0) + 3 AS c FROM s0),
        s1 AS (SELECT s0.*, m, m * (1 - m) / c AS v FROM s0, top),
        xs AS (SELECT (1 - r) / r AS s FROM (SELECT least(0.9, greatest(0.01, coalesce((sum(n * (k / n - m) ** 2) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.01))) AS r FROM s1 WHERE n > 0)),
        xe AS (SELECT s1.*, m * (1 - m) / ((m * (1 - m) - v) / (s + 1) + v) - 1 AS e FROM s1, xs),
        xp AS (SELECT *, (k + e * m) / (n + e) AS post FROM xe),
        x AS (SELECT *, post * (1 - post) / (n + e + 1) AS spread FROM xp),
        d1 AS (SELECT d.*, post AS m, spread AS v FROM d JOIN x USING (suffix)),
        ys AS (SELECT (1 - r) / r AS s FROM (SELECT least(0.9, greatest(0.01, coalesce((sum(n * (k / n - m) ** 2) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.01))) AS r FROM d1 WHERE n > 0)),
        ye AS (SELECT d1.*, m * (1 - m) / ((m * (1 - m) - v) / (s + 1) + v) - 1 AS e FROM d1, ys),
        yp AS (SELECT *, (k + e * m) / (n + e) AS post FROM ye),
        y AS (SELECT *, post * (1 - post) / (n + e + 1) AS spread FROM yp),
        h1 AS (SELECT h.*, post AS m, spread AS v FROM h JOIN y USING (suffix, domain)),
        zs AS (SELECT (1 - r) / r AS s FROM (SELECT least(0.9, greatest(0.01, coalesce((sum(n * (k / n - m) ** 2) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.01))) AS r FROM h1 WHERE n > 0)),
        ze AS (SELECT h1.*, m * (1 - m) / ((m * (1 - m) - v) / (s + 1) + v) - 1 AS e FROM h1, zs),
        zp AS (SELECT *, (k + e * m) / (n + e) AS post FROM ze),
        z AS (SELECT *, post * (1 - post) / (n + e + 1) AS spread FROM zp)
        SELECT page_id, l.host, path, rule, coalesce(said, CASE WHEN post - 1.645 * sqrt(spread) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM l JOIN z ON l.host = z.host""",
    "op11_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        x AS (SELECT *, CAST(len(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
        f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
                least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM x),
        p AS (SELECT doc_id, n, form, text, array_to_string(t[1:a], '') AS pre, array_to_string(t[a + 1:b], '') AS mid, array_to_string(t[b + 1:], '') AS suf FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
}
