"""The operators over the given tables: one query each, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import common, decontaminate, fertility, fim, langid, neighbours, packing, passages, pii, simhash, site_lines, tokens, toxicity, turns


SLOP = 3
"""Words that may stand among the ten of a benchmark window, in any order."""

PASSAGE_WORDS = 50
"""A repeated unit of so many words is a passage, not a phrase."""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), slop=SLOP)
    return found.select(
        "doc_id",
        "n_words",
        F.col("n_exact").cast("long").alias("n_hit"),
        F.size("exact_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("exact_items", ","), 256).alias("items_sha256"),
        (F.col("n_exact") > 0).alias("contaminated"),
        F.col("n_hit").cast("long").alias("n_near_hit"),
        F.size("items").cast("long").alias("n_near_items"),
        F.sha2(F.array_join("items", ","), 256).alias("near_items_sha256"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.dedup_units(spark, read(spark, sf_dir, "documents"), "line", min_words=8, min_chars=40)
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return found.select(
        "doc_id",
        "n_units",
        F.size("removed").alias("n_removed"),
        "n_removed_words",
        "n_repeated_words",
        "longest_repeated",
        (F.col("longest_repeated") >= PASSAGE_WORDS).alias("repeats_passage"),
        F.array_join(spans, ",").alias("removed"),
        "kept_text",
    )


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated_passages(spark, read(spark, sf_dir, "documents"), PASSAGE_WORDS)
    spans = F.transform("passages", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return found.select(
        "doc_id",
        "n_words",
        "n_passage_words",
        "longest_passage",
        (F.col("n_passage_words") > 0).alias("repeats_passage"),
        F.array_join(spans, ",").alias("passages"),
    )


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fertility.verdicts(spark, read(spark, sf_dir, "documents"))
    return found.drop("_key1", "_key2")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    train = ~common.held_out(F.col("doc_id"), 4, 2)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), train)
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", common.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = site_lines.drop_boilerplate(spark, read(spark, sf_dir, "documents"), n_dropped="n_dropped")
    return found.select("doc_id", "source", "n_dropped", "text")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(read(spark, sf_dir, "documents"))
    counts = [pii.count(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    counts += [pii.count(F.col("added"), k).alias(f"n_{k}") for k in pii.EXTRA]
    counts.append((F.size("base") + F.size("added")).cast("long").alias("n_spans"))
    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(every).alias("spans"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.count_tokens(spark, read(spark, sf_dir, "documents"))
    return found.withColumn("over_limit", F.col("n_tokens") > 512)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs, ~common.held_out(F.col("doc_id"), 3, 1))
    found = langid.predict(docs, model)
    return found.select("doc_id", common.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(read(spark, sf_dir, "documents"), packing.n_words(F.col("text")))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(spark, read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "conversations")
    return turns.repair(spark, turns.damaged(table), table)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.fill_in_middle(read(spark, sf_dir, "documents"), check=True)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_substring_dedup,
        op3_fertility,
        op4_toxicity,
        op5_simhash,
        op6_site_lines,
        op7_pii,
        op8_token_counts,
        op9_language,
        op10_packing,
        op11_neighbours,
        op12_conversations,
        op13_fill_in_middle,
        repeated_passages,
    )
}

ORACLES: dict[str, str] = {
    "op1_decontamination": r"""
        WITH item AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        phrase AS (
            SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(10, len(w)) AS n,
                array_to_string(w[i + 1 : i + least(10, len(w))], ' ') AS p
            FROM (SELECT item_id, w, unnest(range(0, greatest(1, len(w) - 9))) AS i FROM item WHERE len(w) > 0)),
        doc AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        place AS (
            SELECT r, n, i, array_to_string(w[i + 1 : i + n], ' ') AS p
            FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM doc, (SELECT DISTINCT n FROM phrase) WHERE len(w) >= n)),
        hit AS (SELECT r, n, i, item_id FROM place JOIN phrase USING (n, p)),
        covered AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY r),
        items AS (SELECT r, list_sort(list(DISTINCT item_id)) AS ids FROM hit GROUP BY r),
        word AS (SELECT p, n, x, count(*) AS c FROM (SELECT p, n, unnest(string_split(p, ' ')) AS x FROM (SELECT DISTINCT p, n FROM phrase)) GROUP BY ALL),
        need AS (SELECT p, n, list({x: x, c: c}) AS need FROM word GROUP BY ALL),
        seen AS (SELECT DISTINCT r, unnest(w) AS x FROM doc),
        holds AS (SELECT r, p, n FROM seen JOIN word USING (x) JOIN need USING (p, n) GROUP BY r, p, n, len(need) HAVING count(*) = len(need)),
        run AS (SELECT r, p, n, i, w[i + 1 : least(i + n + 3, len(w))] AS run
            FROM (SELECT r, p, n, w, unnest(range(0, len(w))) AS i FROM holds JOIN doc USING (r))),
        near AS (SELECT r, p, n, i, len(run) AS l FROM run JOIN need USING (p, n)
            WHERE len(list_filter(need, lambda q: len(list_filter(run, lambda y: y = q.x)) < q.c)) = 0),
        near_covered AS (SELECT r, count(DISTINCT pos) AS n_near FROM (SELECT r, unnest(range(i, i + l)) AS pos FROM near) GROUP BY r),
        near_items AS (SELECT r, list_sort(list(DISTINCT item_id)) AS near_ids FROM near JOIN phrase USING (n, p) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
            sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
            coalesce(n_near, 0) AS n_near_hit, coalesce(len(near_ids), 0) AS n_near_items, sha256(coalesce(array_to_string(near_ids, ','), '')) AS near_items_sha256
        FROM doc LEFT JOIN covered USING (r) LEFT JOIN items USING (r) LEFT JOIN near_covered USING (r) LEFT JOIN near_items USING (r)""",
    "op2_substring_dedup": r"""
        WITH unit AS (
            SELECT doc_id, u, l, trim(regexp_replace(lower(l), '[^\p{L}\p{N}]+', ' ', 'g')) AS k,
                sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY u) - length(l) - 1 AS pos
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS u FROM documents)),
        sized AS (SELECT *, len(string_split(k, ' ')) AS n, k <> '' AND (len(string_split(k, ' ')) >= 8 OR length(k) >= 40) AS taken FROM unit),
        judged AS (
            SELECT *, taken AND row_number() OVER (PARTITION BY k ORDER BY doc_id, u) > 1 AS gone,
                taken AND min(doc_id) OVER (PARTITION BY k) <> max(doc_id) OVER (PARTITION BY k) AS shared FROM sized)
        SELECT doc_id, CAST(count(*) AS INTEGER) AS n_units, CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed,
            CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS n_removed_words, CAST(coalesce(sum(n) FILTER (shared), 0) AS BIGINT) AS n_repeated_words,
            CAST(coalesce(max(n) FILTER (shared), 0) AS BIGINT) AS longest_repeated, coalesce(max(n) FILTER (shared), 0) >= 50 AS repeats_passage,
            coalesce(string_agg(CAST(pos AS BIGINT) || ':' || CAST(pos + length(l) AS BIGINT), ',' ORDER BY u) FILTER (gone), '') AS removed,
            coalesce(string_agg(l, chr(10) ORDER BY u) FILTER (NOT gone), '') AS kept_text
        FROM judged GROUP BY doc_id""",
    "repeated_passages": r"""
        WITH doc AS (SELECT doc_id, coalesce(text, '') AS t, dense_rank() OVER (ORDER BY doc_id, text) AS r FROM documents),
        cut AS (SELECT DISTINCT r, regexp_extract_all(t, '[^\p{L}\p{N}]*[\p{L}\p{N}]+') AS p, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM doc),
        word AS (
            SELECT r, i, e - length(regexp_extract(p, '[\p{L}\p{N}]+')) AS s, e
            FROM (SELECT r, i, p, sum(length(p)) OVER (PARTITION BY r ORDER BY i) AS e FROM (SELECT r, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM cut))),
        place AS (
            SELECT r, i, md5(array_to_string(w[i : i + 49], ' ')) AS k
            FROM (SELECT r, w, unnest(range(1, len(w) - 48)) AS i FROM cut WHERE len(w) >= 50)),
        hit AS (SELECT r, i FROM place JOIN (SELECT k FROM place GROUP BY k HAVING min(r) <> max(r)) USING (k)),
        begun AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 50, true) AS b FROM hit),
        span AS (
            SELECT r, min(i) AS a, max(i) + 49 AS z FROM (SELECT r, i, sum(CAST(b AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS g FROM begun)
            GROUP BY r, g),
        told AS (
            SELECT span.r, CAST(sum(z - a + 1) AS BIGINT) AS n, max(z - a + 1) AS longest,
                string_agg(CAST(x.s AS BIGINT) || ':' || CAST(y.e AS BIGINT), ',' ORDER BY a) AS spans
            FROM span JOIN word x ON x.r = span.r AND x.i = a JOIN word y ON y.r = span.r AND y.i = z GROUP BY span.r)
        SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_passage_words, coalesce(longest, 0) AS longest_passage, n IS NOT NULL AS repeats_passage,
            coalesce(spans, '') AS passages
        FROM doc JOIN cut USING (r) LEFT JOIN told USING (r)""",
    "op13_fill_in_middle": r"""
        WITH cut AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
                regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
        drawn AS (
            SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(d, k, 8) AS BIGINT)) AS h FROM cut),
        ended AS (
            SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
                    WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
        part AS (
            SELECT doc_id, n, form, t, coalesce(array_to_string(u[1 : a], ''), '') AS p, coalesce(array_to_string(u[a + 1 : b], ''), '') AS m,
                coalesce(array_to_string(u[b + 1 : n], ''), '') AS s FROM ended)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
                AS output_sha256, sha256(t) AS restored_sha256
        FROM part""",
    "op6_site_lines": r"""
        WITH line AS (
            SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS u FROM documents),
        total AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        often AS (
            SELECT source, k FROM (SELECT source, trim(l, ' ') AS k, count(DISTINCT doc_id) AS n_with FROM line GROUP BY 1, 2) JOIN total USING (source)
            WHERE k <> '' AND n_with >= 5 AND n_with > 0.1 * n),
        judged AS (SELECT line.*, k IS NOT NULL AS gone FROM line LEFT JOIN often ON line.source = often.source AND trim(l, ' ') = k)
        SELECT doc_id, source, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(l, chr(10) ORDER BY u) FILTER (NOT gone), '') AS text
        FROM judged GROUP BY doc_id, source""",
}
