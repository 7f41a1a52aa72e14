"""Named queries over the shared tables, each with equivalent SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """Attribute access to the parquet tables of one directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    @property
    def heavy_events(self) -> DataFrame:
        """Events for work that is heavy per row."""
        return self.events

    @property
    def texts(self) -> DataFrame:
        """Documents for work that is heavy per text."""
        return self.documents.select("doc_id", "text", "lang", "source")


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# ---- shared derivations: the same input in Spark and in SQL ----

# Rule set over the generated prose; same shape as the medical rules.
TEXT_GROUPS = {"english": [" the ", " and "], "french": [" les ", " des "], "german": [" der ", " und "], "spanish": [" los ", " por "]}
TEXT_RULES = [
    dict(type="E", subtype="low_trust", confidence=0.85, description="flagged: low_trust",
         when=[("qa", "any", ["token =", "password", "api_key", "secret"])], boost=(("a", "any", ["@", "http"]), 0.95)),
    dict(type="D", subtype="english_french", confidence=0.9, description="mixed: ", detect=TEXT_GROUPS,
         when=[("a", "any", TEXT_GROUPS["english"]), ("a", "any", TEXT_GROUPS["french"])]),
    dict(type="D", subtype="german_spanish", confidence=0.9, description="mixed: ", detect=TEXT_GROUPS,
         when=[("a", "any", TEXT_GROUPS["german"]), ("a", "any", TEXT_GROUPS["spanish"])]),
    dict(type="C", subtype="chained", confidence=0.85, description="chained",
         when=[("a", "any", ["license", "copyright", "%%%"]), ("qa", "any", ["src1", "ing "])]),
    dict(type="A", subtype="plain_en", confidence=0.75, description="plain: plain_en",
         when=[("qa", "any", ["en src", "wiki"]), ("a", "any", ["tion", "ing"]), ("a", "none", ["$$$", "!!"])]),
    dict(type="A", subtype="plain_other", confidence=0.75, description="plain: plain_other",
         when=[("qa", "any", ["fr src", "de src", "es src"]), ("a", "none", ["###", "***"])]),
]


def rules_sql(rules: Sequence[dict], q: str = "q", a: str = "a") -> dict[str, str]:
    """SQL expressions for type, subtype, confidence, description of the first matching rule."""
    def any_of(text: str, words: Sequence[str]) -> str:
        return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"

    def cond(where: str, mode: str, words: Sequence[str]) -> str:
        hit = "(" + " OR ".join(any_of({"q": q, "a": a}[c], words) for c in where) + ")"
        return f"NOT {hit}" if mode == "none" else hit

    def case(value) -> str:
        arms = " ".join(
            "WHEN " + " AND ".join(cond(*w) for w in r["when"]) + f" THEN {value(r)}" for r in rules
        )
        return f"CASE {arms} END"

    def conf(r: dict) -> str:
        base = f"CAST({r['confidence']} AS DOUBLE)"
        if "boost" not in r:
            return base
        c, high = r["boost"]
        return f"CASE WHEN {cond(*c)} THEN CAST({high} AS DOUBLE) ELSE {base} END"

    def text(r: dict) -> str:
        if "detect" not in r:
            return f"'{r['description']}'"
        parts = ", ".join(f"CASE WHEN {any_of(a, w)} THEN '{n}' END" for n, w in r["detect"].items())
        return f"'{r['description']}' || concat_ws(', ', {parts})"

    return {"type": case(lambda r: f"'{r['type']}'"), "subtype": case(lambda r: f"'{r['subtype']}'"),
            "confidence": case(conf), "description": case(text)}


_r = rules_sql(TEXT_RULES)
CLS_SQL = f"""cls AS (SELECT doc_id, dataset, a AS answer_text, {_r['type']} AS type, {_r['subtype']} AS subtype,
  {_r['confidence']} AS confidence, {_r['description']} AS description
  FROM (SELECT doc_id, source AS dataset, lower(lang || ' ' || source) AS q, lower(text) AS a FROM documents))"""


def classified_documents(t: Tables) -> DataFrame:
    from ..operators.classify import classify

    docs = t.texts.select(
        "doc_id", F.col("source").alias("dataset"), F.concat_ws(" ", "lang", "source").alias("question"),
        F.col("text").alias("ground_truth_answer"),
    )
    return classify(docs, rules=TEXT_RULES, expand=False)


QA_SQL = """qa AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS question,
  arg_min(text, turn) FILTER (WHERE role = 'assistant') AS answer FROM conversations GROUP BY conv_id)"""


def first_turns(t: Tables) -> DataFrame:
    """One row per conversation: text of the lowest user and the lowest assistant turn."""
    turn = lambda role: F.min_by("text", F.when(F.col("role") == role, F.col("turn")))
    return t.conversations.groupBy("conv_id").agg(turn("user").alias("question"), turn("assistant").alias("answer"))


# Trajectories: pieces are left out by conversation number; truth is a benchmark text.
PIECES_SQL = f"""{QA_SQL}, b AS (SELECT item_id, text AS truth FROM benchmark), nb AS (SELECT count(*) AS n FROM benchmark),
traj AS (SELECT conv_id, coalesce(answer, '') AS body, truth,
  CASE WHEN conv_id % 3 = 0 THEN 'B-artifact' ELSE 'A-healthy' END AS reasoning_type,
  CASE WHEN conv_id % 5 = 4 THEN '' ELSE '<think>plan ' || coalesce(question, '') || '</think>' END
  || CASE WHEN conv_id % 4 <> 1 THEN '<tool_call>first</tool_call><observation>status ok ' || coalesce(answer, '') || '</observation>' ELSE '<tool_call>first</tool_call>' END
  || CASE WHEN conv_id % 6 = 0 THEN '<think>but see</think><tool_call>second</tool_call><observation>failed unknown</observation>' ELSE '' END
  || CASE WHEN conv_id % 4 = 2 THEN '' WHEN conv_id % 7 = 0 THEN '<answer>' || truth || '</answer>' ELSE '<answer>' || coalesce(answer, '') || '</answer>' END AS trajectory,
  CASE WHEN conv_id % 6 = 0 THEN ['ok', 'failed', NULL] WHEN conv_id % 4 = 3 THEN CAST([] AS VARCHAR[]) ELSE ['ok'] END AS statuses
  FROM qa CROSS JOIN nb JOIN b ON b.item_id = conv_id % nb.n)"""


def trajectories(t: Tables) -> DataFrame:
    """Trajectory text, tool log, truth and type per conversation."""
    from ..operators.ordering import attach_row

    c, text = F.col("conv_id"), lambda x: F.coalesce(F.col(x), F.lit(""))
    bench = t.benchmark.select("item_id", F.col("text").alias("truth"))
    qa = attach_row(first_turns(t), bench.agg(F.count(F.lit(1)).alias("nb"))).withColumn("item_id", F.pmod(c, "nb"))
    j = qa.join(bench, "item_id")
    think = F.when(c % 5 == 4, "").otherwise(F.concat(F.lit("<think>plan "), text("question"), F.lit("</think>")))
    seen = F.concat(F.lit("<tool_call>first</tool_call><observation>status ok "), text("answer"), F.lit("</observation>"))
    call = F.when(c % 4 != 1, seen).otherwise("<tool_call>first</tool_call>")
    second = F.when(c % 6 == 0, "<think>but see</think><tool_call>second</tool_call><observation>failed unknown</observation>").otherwise("")
    answer = (
        F.when(c % 4 == 2, "").when(c % 7 == 0, F.concat(F.lit("<answer>"), F.col("truth"), F.lit("</answer>")))
        .otherwise(F.concat(F.lit("<answer>"), text("answer"), F.lit("</answer>")))
    )
    # a result without a status: the log's own status is then filled in, and must not be matched
    entry = lambda i, s: F.struct(
        F.lit(f"tool{i}").alias("tool_name"), F.struct(F.lit(s).cast("string").alias("status")).alias("result"), F.lit(s or "unknown").alias("status"))
    log = (
        F.when(c % 6 == 0, F.array(entry(1, "ok"), entry(2, "failed"), entry(3, None)))
        .when(c % 4 == 3, F.array().cast("array<struct<tool_name:string,result:struct<status:string>,status:string>>")).otherwise(F.array(entry(1, "ok")))
    )
    return j.select(
        "conv_id", F.concat(think, call, second, answer).alias("trajectory"), log.alias("tool_execution_log"),
        F.col("truth").alias("ground_truth_answer"),
        F.when(c % 3 == 0, "B-artifact").otherwise("A-healthy").alias("reasoning_type"),
    )


# Feature tables: orders per customer and status; small groups count as missing (-1).
FEATS_SQL = """o AS (SELECT CAST(o_custkey AS VARCHAR) AS Name, o_orderstatus AS s, count(*) AS n,
  round(sum(o_totalprice), 2) AS v, round(max(o_totalprice), 2) AS m FROM orders GROUP BY 1, 2),
f AS (SELECT Name, s, CASE WHEN n < 3 THEN -1 ELSE v END AS v, CASE WHEN n < 4 THEN -1 ELSE m END AS m, n FROM o)"""


def status_table(t: Tables, status: str, v: str, m: str | None = None) -> DataFrame:
    o = t.orders.where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").cast("string").alias("Name")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("v"), F.round(F.max("o_totalprice"), 2).alias("m")
    )
    cols = [F.when(F.col("n") < 3, -1.0).otherwise(F.col("v")).alias(v)]
    if m:
        cols.append(F.when(F.col("n") < 4, -1.0).otherwise(F.col("m")).alias(m))
    return o.select("Name", *cols)


# Pixels: image = supplier, position from part and order number, class from the return flag.
PX_SQL = """px AS (SELECT DISTINCT l_suppkey AS image, l_returnflag AS lesion, CAST(l_partkey % 64 AS BIGINT) AS x,
  CAST(l_orderkey % 64 AS BIGINT) AS y FROM lineitem)"""


def pixels(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_suppkey").alias("image"), F.col("l_returnflag").alias("lesion"),
        (F.col("l_partkey") % 64).alias("x"), (F.col("l_orderkey") % 64).alias("y"),
    ).distinct()


def pixel_dims(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("image"), F.lit(64).alias("width"), F.lit(64).alias("height"))


# Paths: image = user, vessel = event type, order by time; x = hours, y = value.
PTS_SQL = """pts AS (SELECT user_id AS image, event_type AS vessel,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS seq,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0 AS x, value AS y FROM events)"""


def path_points(t: Tables) -> DataFrame:
    from ..operators.ordering import dense_rank_in_group

    # wall-clock microseconds since 2024-01-01, whatever the session's time zone
    gap = "(cast(ts as timestamp_ntz) - timestamp_ntz'2024-01-01 00:00:00')"
    micros = F.expr(
        f"(extract(day from {gap}) * 86400L + extract(hour from {gap}) * 3600L + extract(minute from {gap}) * 60L) * 1000000L"
        f" + cast(extract(second from {gap}) * 1000000 as bigint)"
    )
    rows = t.events.select(
        F.col("user_id").alias("image"), F.col("event_type").alias("vessel"), "event_id", micros.alias("us"),
        F.col("value").alias("y"),
    )
    seq = dense_rank_in_group(rows, ["image", "vessel"], [F.col("us"), F.col("event_id")])
    return seq.select("image", "vessel", "seq", (F.col("us") / 3600000000.0).alias("x"), "y")


# Query vectors: the mean vector of each label (label = query id).
QVEC_SQL = """qlong AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, unnest(range(1, 65)) AS u(i) GROUP BY ALL),
q AS (SELECT label AS query_id, list(v ORDER BY i) AS qv FROM qlong GROUP BY label)"""


def label_means(t: Tables) -> DataFrame:
    """One query per label: its mean vector, combined map-side in one buffer per label."""
    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    means = t.embeddings.groupBy(F.col("label").alias("query_id")).agg(mean.alias("m"))
    return means.select("query_id", vector_to_array("m").alias("query_vec"))


PROBS_SQL = """pr AS (SELECT vec_id, label, [exp(CAST(embedding[1] AS DOUBLE)), exp(CAST(embedding[2] AS DOUBLE)), exp(CAST(embedding[3] AS DOUBLE))] AS e FROM embeddings),
probs AS (SELECT vec_id, label, list_transform(e, lambda v: v / (e[1] + e[2] + e[3])) AS p FROM pr)"""


def probabilities(t: Tables) -> DataFrame:
    from ..functions.columns import exp_normalize

    three = F.array(*[F.get("embedding", F.lit(i)).cast("double") for i in range(3)])
    return t.embeddings.select("vec_id", "label", exp_normalize(three).alias("probs"))
