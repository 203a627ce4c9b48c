"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vecloom.llm.phrases import sql as phrases_sql
from vecloom.llm.sale_enrichment import SQL as SALES

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.url_graph import judge

    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.nn_descent import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.ring_sharding import assign

    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.exact_topk import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.near_dedup import classes

    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.language_id import identify

    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.kneser_ney import classify

    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.bpe import tokenizer_path
    from vecloom.llm.packing import pack

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.bpe import digests, tokenizer_path

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"))


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.katz import score

    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_sale_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.sale_enrichment import enrich

    return enrich(spark.read.parquet(f"{sf_dir}/sales.parquet"), spark.read.parquet(f"{sf_dir}/client_changes.parquet"))


def op12_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.bpe import tokenizer_path
    from vecloom.llm.tiered_packing import pack

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vecloom.llm.phrases import mine

    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_graph, op2_nn_descent, op3_ring_sharding, op4_exact_topk, op5_language_id, op6_near_dedup, op7_kneser_ney, op8_packing, op9_bpe, op10_katz, op11_sale_enrichment, op12_tiered_packing, op13_collocations)
}



def _rule_sql(column: str) -> str:
    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if column == 'rule' else verdict}'" for verdict, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])))
    return f"CASE {cases} END"


def _url_sql(rounds: int = 16) -> str:
    from vecloom.llm.url_graph import LINK, LOWER, TOTAL, UPPER

    low = f"'{UPPER}', '{LOWER}'"
    link = LINK.replace("'", "''")
    out = [
        f"p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {low}), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages)",
        f"j AS (SELECT page_id, host, path, {_rule_sql('rule')} AS rule, {_rule_sql('verdict')} AS verdict FROM p)",
        f"l AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS target FROM p), k AS (SELECT src, translate(regexp_extract(target, '^[^/?#]*', 0), {low}) AS host, regexp_extract(target, '^[^/?#]*([^?#]*)', 1) AS path FROM l)",
        f"e AS (SELECT src, host AS dst, CAST(sign(sum(CASE {_rule_sql('verdict')} WHEN 'allow' THEN 1 WHEN 'block' THEN -1 ELSE 0 END)) AS INTEGER) AS vote FROM k WHERE src <> host AND src <> '' AND host <> '' GROUP BY src, host)",
        "g AS (SELECT src, dst, 0 AS kind FROM e UNION ALL SELECT dst, src, 1 FROM e)",
        "w AS (SELECT *, count(*) OVER (PARTITION BY src, kind) AS degree FROM g)",
        "own AS (SELECT host, sum(CASE verdict WHEN 'allow' THEN 1 WHEN 'block' THEN -1 ELSE 0 END) AS l FROM j WHERE host <> '' GROUP BY host)",
        "lean AS (SELECT host, coalesce(own.l, v.l) AS l FROM own FULL JOIN (SELECT dst AS host, sum(vote) AS l FROM e GROUP BY dst) v USING (host))",
        "s AS (SELECT host, CASE WHEN l > 0 THEN 0 ELSE 1 END AS kind FROM lean WHERE l <> 0)",
        f"m0 AS (SELECT host, kind, {TOTAL}::BIGINT // count(*) OVER (PARTITION BY kind) AS mass FROM s)",
        "st AS (SELECT host, kind, mass // 20 * 3 AS mass FROM m0)",
    ]
    for k in range(rounds):
        out.append(f"m{k + 1} AS MATERIALIZED (SELECT host, kind, CAST(sum(mass) AS BIGINT) AS mass FROM (SELECT w.dst AS host, m.kind, (m.mass - m.mass // 20 * 3) // w.degree AS mass FROM m{k} m JOIN w ON w.src = m.host AND w.kind = m.kind UNION ALL SELECT * FROM st) GROUP BY host, kind)")
    out.append(f"t AS (SELECT host, CAST(sum(CASE WHEN kind = 0 THEN mass ELSE 0 END) AS BIGINT) AS trust, CAST(sum(CASE WHEN kind = 1 THEN mass ELSE 0 END) AS BIGINT) AS distrust FROM m{rounds} GROUP BY host)")
    return "WITH " + ", ".join(out) + " SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM j LEFT JOIN t USING (host)"


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL: dict[str, str] = {
    "op1_url_graph": _url_sql(),
    "op4_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(min(embedding), lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 10""",
    "op6_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT u, v FROM c JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
        r AS (SELECT doc_id AS node, doc_id AS label FROM documents UNION SELECT e.v, r.label FROM r JOIN e ON e.u = r.node),
        t AS (SELECT node, min(label) AS label FROM r GROUP BY node)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, label AS component_id, d.doc_id = label AS kept FROM documents d JOIN t ON t.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op11_sale_enrichment": SALES,
    "op13_collocations": phrases_sql(),
}
