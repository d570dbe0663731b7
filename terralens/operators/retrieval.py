"""Text chunks, vectors and the context of an answer."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalised(v: Column) -> Column:
    """Vector over its length (plus 1e-9, so a zero vector stays zero)."""
    n = norm(v) + F.lit(1e-9)
    return F.transform(v, lambda x: x.cast("double") / n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def retrieve(df: DataFrame, query: list[float], k: int = 6, vector: str = "embedding", key: str = "vec_id", digits: int = 4) -> DataFrame:
    """The k rows most similar to one query vector, which is a literal of the plan."""
    q = F.array(*[F.lit(float(x)) for x in query])
    length = sum(float(x) ** 2 for x in query) ** 0.5 + 1e-9
    v = F.col(vector)
    cos = dot(v, q) / ((norm(v) + F.lit(1e-9)) * F.lit(length))
    s = F.floor(cos * float(10**digits) + 0.5) / float(10**digits)
    return df.withColumn("score", s).orderBy(F.col("score").desc(), F.col(key)).limit(k)


def chunk(df: DataFrame, key: str, text: str, mark: str = "\n## ", cap: int = 1200) -> DataFrame:
    """(id, texto): the parts of each document between headings, trimmed, empty ones
    dropped; the id ends in the part's place. A part longer than ``cap`` characters goes
    on in further chunks, numbered behind the place, so no text is left out."""
    parts = F.posexplode(F.split(text, F.lit("\\Q" + mark + "\\E")))
    rows = df.select(F.col(key).alias("_key"), parts.alias("_i", "_part")).withColumn("_part", F.trim("_part", F.lit(" \t\n\r"))).filter("_part <> ''")
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((F.length("_part") - 1) / cap).cast("int"))))
    place = F.when(F.col("_k") == 0, F.col("_i").cast("string")).otherwise(F.concat_ws(".", F.col("_i").cast("string"), F.col("_k").cast("string")))
    return rows.select(F.concat_ws("-", F.col("_key").cast("string"), place).alias("id"), F.substring(F.col("_part"), F.col("_k") * cap + 1, F.lit(cap)).alias("texto"))


def context(df: DataFrame, ident: str, text: str, order: str) -> DataFrame:
    """One row: ``[id] text`` lines in order, of a handful of retrieved rows."""
    line = F.concat(F.lit("["), F.col(ident).cast("string"), F.lit("] "), F.col(text))
    rows = df.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("r"))
    return rows.select(F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("prompt"))


def embedded(df: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]], batch: int = 64, name: str = "vector") -> DataFrame:
    """With vectors of an embedder called on batches; the embedder is the caller's."""
    schema = df.schema.simpleString()[7:-1] + f",{name}:array<float>"

    def run(it: Iterator[pd.DataFrame]):
        for pdf in it:
            out = []
            for i in range(0, len(pdf), batch):
                out += embedder(pdf[text].iloc[i : i + batch].fillna("").tolist())
            yield pdf.assign(**{name: out})

    return df.mapInPandas(run, schema)


#: Own wording: what an assistant needs to know about the system and its indices.
KNOWLEDGE = (
    ("purpose", "The engine ranks territories by environmental pressure so that reviewers know where to look first; a rank is a reason to review and proves neither cause nor offence."),
    ("coverage", "Every territory of the spine has one row, whether or not a source mentions it; counts of a source that is silent are zero."),
    ("mining-source", "Mining comes from a registry of titles and a table of produced volume and royalties, joined by exact territory code; it covers formal activity only."),
    ("forest-source", "Forest loss is a yearly table joined by normalised name; the worst year counts, and a territory without a row counts as without significant loss."),
    ("water-source", "Water quality samples belong to the nearest territory centroid within fifty kilometres; a territory's quality is the mean of its valid samples."),
    ("protected-source", "Protected areas are assigned to the nearest centroid with their hectares; membership of the peace programme comes from a list of codes."),
    ("fire-source", "Hot spots of the last seven days come from three satellite products, are placed in territories by point in polygon, and are counted with their radiative power."),
    ("indices", "There are five indices from 0 to 1: mining, forest loss, fire, water and sensitivity."),
    ("sensitivity", "Sensitivity is what there is to protect: it grows with protected hectares, and a peace-programme territory gets a quarter more, up to 1."),
    ("reading", "On every index 1 calls for attention and 0 means no signal; a water index of 0 can also mean that nobody measured, which a flag tells apart."),
    ("normalisation", "Indices of long-tailed measures take log(1 + x) and are stretched between the table's least and largest value; the water index is one minus the mean quality."),
    ("score", "The score weighs mining 0.30, forest 0.25, water 0.20, fire 0.15 and sensitivity 0.10."),
    ("levels", "Levels are quantiles of the score within the table: the top 5 percent, the next 10, the next 25, and the rest."),
    ("model", "A boosted-tree classifier predicts the level from fifteen columns, the five indices and ten raw measures, with 300 rounds of depth 4 and a split by class of 75 to 25."),
    ("metrics", "Accuracy is shown beside that of always naming the commonest level, since the label is a formula that the model learns again."),
    ("shapley", "Shapley values split each prediction among the columns; their mean size ranks the columns over the whole table."),
    ("certainty", "Conformal sets hold the true level nine times in ten; one level in the set means high certainty, two medium, more low."),
    ("anomaly", "An isolation forest flags the twentieth of the territories that are easiest to tell apart; some of them have a low score and merit a look."),
    ("raster", "Forest change between two satellite dates is the drop of a vegetation index over former forest, summed up by territory in hectares."),
    ("assistant", "The assistant answers from retrieved chunks only and names them; embeddings and text come from services that the operator chooses."),
    ("limits", "Missing data is marked and not invented, raster results hold for the scenes they were made from, and accuracy is not offered as merit."),
    ("refresh", "The fire signal is refreshed daily; the other sources and the model change when new tables arrive."),
)


def knowledge(spark) -> DataFrame:
    return spark.createDataFrame([(f"kb-{i}", "conocimiento", "", t) for i, t in KNOWLEDGE], "id string, tipo string, municipio string, texto string")


def ranking_chunk(df: DataFrame, ident: str, title: str, by: str, key: str, name: str, place: str, fmt: str, n: int = 10) -> DataFrame:
    """One row: the n rows with the largest value as a sentence."""
    top = df.orderBy(F.col(by).desc(), F.col(key)).limit(n)
    item = F.format_string(f"%s (%s) {fmt}", F.col(name), F.col(place).cast("string"), F.col(by))
    listed = top.agg(F.array_sort(F.collect_list(F.struct((-F.col(by)).alias("v"), F.col(key).alias("k"), item.alias("t")))).alias("r"))
    text = F.concat(F.lit(title + ": "), F.array_join(F.transform("r", lambda x: x["t"]), ", "), F.lit("."))
    return listed.select(F.lit(ident).alias("id"), F.lit("resumen").alias("tipo"), F.lit("").alias("municipio"), text.alias("texto"))


def group_chunks(df: DataFrame, group: str, key: str, name: str, high: Column, score: str, events: str, n: int = 6) -> DataFrame:
    """One row per group that has a high row or an event: its n highest rows by score
    and its n rows with most events. Ranks are cut to n before rows are gathered."""
    def best(rows: DataFrame, by: str, item: Column, out: str) -> DataFrame:
        order = Window.partitionBy(group).orderBy(F.col(by).desc(), F.col(key))
        kept = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n)
        listed = F.array_sort(F.collect_list(F.struct("_n", item.alias("t"))))
        return kept.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x["t"]), ", ").alias(out))

    ranked = best(df.filter(high), score, F.format_string("%s (%s, score %.4f)", F.col(name), F.col("riesgo_nivel"), F.col(score)), "_high")
    burnt = best(df.filter(F.col(events) > 0), events, F.format_string("%s %d", F.col(name), F.col(events)), "_fire")
    both = ranked.join(burnt, group, "full")
    text = F.concat_ws(" ", F.concat(F.lit("Department "), F.col(group).cast("string"), F.lit(".")), F.concat(F.lit("Highest priority: "), F.col("_high"), F.lit(".")), F.concat(F.lit("Most hot spots: "), F.col("_fire"), F.lit(".")))
    return both.select(F.concat(F.lit("resumen-dep-"), F.col(group).cast("string")).alias("id"), F.lit("resumen").alias("tipo"), F.lit("").alias("municipio"), text.alias("texto"))


def ask(question: str, corpus: DataFrame, embedder: Callable[[list[str]], list[list[float]]], complete: Callable[[list[dict]], str], k: int = 6, vector: str = "vector") -> dict:
    """Answer from the k chunks nearest to the question: {answer, sources}. The chat
    service is the caller's: ``complete`` takes messages and returns the reply."""
    near = retrieve(corpus, embedder([question])[0], k, vector, "id")
    rows = near.select("id", "texto", "score").orderBy(F.col("score").desc(), "id").collect()  # k rows
    evidence = "\n".join(f"[{r['id']}] {r['texto']}" for r in rows)
    rule = "Answer from the evidence alone, name the chunks you use in brackets, and say so where the evidence does not tell."
    reply = complete([{"role": "system", "content": rule}, {"role": "user", "content": f"Evidence:\n{evidence}\n\nQuestion: {question}"}])
    return {"answer": reply, "sources": [(r["id"], r["score"]) for r in rows]}


def chat_service(url: str, model: str, token: str = "", timeout: int = 120, post=None) -> Callable[[list[dict]], str]:
    """A ``complete`` for services with the usual chat interface."""
    def send(messages: list[dict]) -> str:
        body = {"model": model, "messages": messages, "temperature": 0.2}
        return (post or post_json)(url, body, token, timeout)["choices"][0]["message"]["content"]

    return send


def embedding_service(url: str, model: str, token: str = "", timeout: int = 120, post=None) -> Callable[[list[str]], list[list[float]]]:
    """An ``embedder`` for services that take a list of texts."""
    def send(texts: list[str]) -> list[list[float]]:
        got = (post or post_json)(url, {"model": model, "input": texts}, token, timeout)
        return [d["embedding"] for d in got["data"]] if "data" in got else got["embeddings"]

    return send


def post_json(url: str, body: dict, token: str, timeout: int) -> dict:
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    with urlopen(Request(url, json.dumps(body).encode(), head), timeout=timeout) as r:  # noqa: S310
        return json.loads(r.read())
