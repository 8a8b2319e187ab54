"""Entity resolution: blocking, pair scores, components, survivors.

Batch resolution is the design for scale: keys are exploded and equi-joined,
pairs are scored in one projection, pairs above the merge floor become edges of
connected components. All items that share a key are compared, as the semantics
ask. A key of many items is dealt into parts, and each pair of parts is joined by
itself, so no task holds a whole common key; pairs that share several keys are made
distinct on the map side first.
``most`` is an option for tables with very common keys that leaves keys of more items
out of the pairing (equal names and domains still meet).
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.similarity import cosine, jaro_winkler, unit_interval, winkler_at_most
from tessera.operators import graph
from tessera.store import table

# Fixed values of the pair score.
WEIGHTS = {"domain": 0.5, "name": 0.25, "embedding": 0.15, "person": 0.10}
AUTO, UNCERTAIN, STRONG = 0.82, 0.55, 0.85
UNCERTAIN_FLAG = "merge_incierto"
PRECEDENCE = ["github", "rss", "hackernews"]
MAX_HOPS = 25
PART = 2048  # items of a key that meet in one part
PER_TASK = 4_000_000  # pairs that a task lists


# --- blocking --------------------------------------------------------------------


def keyed(items: DataFrame, id_col: str, name: Column, domain: Column) -> DataFrame:
    """(id, key) rows of the blocking keys."""
    return items.select(F.col(id_col).alias("id"), F.explode(T.blocking_keys(name, domain)).alias("key"))


def overlapping(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(incoming_id, stored_id) that share a key; both sides are (id, key) rows."""
    left, right = incoming.withColumnRenamed("id", "incoming_id"), stored.withColumnRenamed("id", "stored_id")
    return left.join(right, "key").select("incoming_id", "stored_id").distinct()


def candidate_pairs(keys: DataFrame, part: int = PART) -> DataFrame:
    """(lo, hi) of all items that share a key, each pair once. keys: (id, key), each row once.

    A key of more than ``part`` items is dealt into parts by id; a row meets its own part and every other one, and of
    the two orders in which two parts meet only one is kept.
    """
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    own = keys.join(sizes, "key").withColumn("parts", F.ceil(F.col("n") / part).cast("int"))
    own = own.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    conf = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(conf, ceil((sizes.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0) / PER_TASK))
    dealt = own.select("key", "id", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    left = dealt.select("key", F.col("id").alias("lo"), F.col("own").alias("p"), F.col("other").alias("q"))
    right = dealt.select("key", F.col("id").alias("hi"), F.col("other").alias("p"), F.col("own").alias("q"))
    on = ["key", "p", "q"]  # a stated number of tasks, since few rows make many pairs
    return left.repartition(tasks, *on).join(right.repartition(tasks, *on), on).where("lo < hi").select("lo", "hi").distinct()


def selective(keys: DataFrame, most: int) -> DataFrame:
    """Keys without those of more than ``most`` items; for blocks whose pairs would grow with their square.

    An item keeps its rarer keys, and an equal name or domain is found by
    :func:`same_value` whatever its number of rows; pairs that share only common keys are not compared.
    """
    common = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    return keys.join(common.select("key"), "key")


def same_value(items: DataFrame, id_col: str, value: Column) -> DataFrame:
    """(lo, hi) edges from each row to the least row of equal value: linear in the rows, however common the value."""
    own = items.select(F.col(id_col).alias("hi"), value.alias("v")).where("v is not null")
    least = own.groupBy("v").agg(F.min("hi").alias("lo"))
    return own.join(least, "v").where("lo < hi").select("lo", "hi")


# --- pairs -----------------------------------------------------------------------


def pair_score(a: str, b: str, embeddings: bool = False) -> list[Column]:
    """score, confidence and matched signals of struct columns a and b.

    Each struct has name and domain (normalised), people, and embedding if asked for.
    """
    side = lambda f: (F.col(f"{a}.{f}"), F.col(f"{b}.{f}"))
    da, db = side("domain")
    both = da.isNotNull() & db.isNotNull()
    domain = F.when(both, (da == db).cast("double"))
    name = jaro_winkler(*side("name"))
    if embeddings:
        ea, eb = side("embedding")
        vector = F.when(ea.isNotNull() & eb.isNotNull(), unit_interval(cosine(ea, eb)))
    else:
        vector = F.lit(None).cast("double")
    pa, pb = side("people")
    people = F.when((F.size(pa) > 0) & (F.size(pb) > 0), F.arrays_overlap(F.transform(pa, T.person), F.transform(pb, T.person)).cast("double"))
    parts = {"domain": domain, "name": name, "embedding": vector, "person": people}
    top = sum((F.coalesce(v * WEIGHTS[k], F.lit(0.0)) for k, v in parts.items()), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), WEIGHTS[k]).otherwise(0.0) for k, v in parts.items()), F.lit(0.0))
    score = top / weight
    signals = F.array_compact(
        F.array(
            F.when(domain == 1, F.lit("domain")),
            F.when(name >= STRONG, F.lit("name-similarity")),
            F.when(vector >= STRONG, F.lit("embedding-similarity")),
            F.when(people == 1, F.lit("shared-person")),
        )
    )
    return [score.alias("score"), band(score, both).alias("confidence"), signals.alias("matched_signals")]


def band(score: Column, both_domains: Column) -> Column:
    """auto, uncertain or none; auto needs both domains."""
    return F.when((score >= AUTO) & both_domains, "auto").when(score >= UNCERTAIN, "uncertain").otherwise("none")


def possible(a: str, b: str, floor: float, embeddings: bool = False) -> Column:
    """Whether the score of struct columns a and b may reach the floor, by bounds that need no name comparison."""
    domains = F.col(f"{a}.domain").isNotNull() & F.col(f"{b}.domain").isNotNull()
    people = (F.size(f"{a}.people") > 0) & (F.size(f"{b}.people") > 0)
    vectors = F.col(f"{a}.embedding").isNotNull() & F.col(f"{b}.embedding").isNotNull() if embeddings else F.lit(False)
    name = WEIGHTS["name"] * winkler_at_most(F.col(f"{a}.name"), F.col(f"{b}.name"))
    top, weight = name, F.lit(WEIGHTS["name"])
    for kind, there, most in (("domain", domains, (F.col(f"{a}.domain") == F.col(f"{b}.domain")).cast("double")), ("person", people, F.lit(1.0)), ("embedding", vectors, F.lit(1.0))):
        top = top + F.when(there, WEIGHTS[kind] * most).otherwise(0.0)
        weight = weight + F.when(there, WEIGHTS[kind]).otherwise(0.0)
    return top / weight >= floor - 1e-9


def score_pairs(pairs: DataFrame, items: DataFrame, id_col: str = "id", embeddings: bool = False, floor: float | None = None) -> DataFrame:
    """``pairs`` (lo, hi) with their scores; items have name, domain, people[, embedding].

    With ``floor``, pairs that cannot reach it are left out before their names are compared.
    """
    fields = ["name", "domain", "people"] + (["embedding"] if embeddings else [])
    side = lambda key, alias: items.select(F.col(id_col).alias(key), F.struct(*fields).alias(alias))
    joined = pairs.join(side("lo", "a"), "lo").join(side("hi", "b"), "hi")
    if floor is not None:
        joined = joined.where(possible("a", "b", floor, embeddings))
    return joined.select("lo", "hi", *pair_score("a", "b", embeddings))


def best_candidate(scored: DataFrame, by: str, candidate: str) -> DataFrame:
    """For each ``by``, its best candidate above the floor: highest score, then least id."""
    top = F.max_by(F.struct(candidate, "score", "confidence"), F.struct("score", F.lit(0)))
    if dict(scored.dtypes)[candidate] in ("bigint", "int"):
        top = F.max_by(F.struct(candidate, "score", "confidence"), F.struct("score", -F.col(candidate)))
        return scored.where("confidence <> 'none'").groupBy(by).agg(top.alias("m")).select(by, "m.*")
    order = Window.partitionBy(by).orderBy(F.desc("score"), candidate)
    return scored.where("confidence <> 'none'").withColumn("_n", F.row_number().over(order)).where("_n = 1").select(by, candidate, "score", "confidence")


# --- clusters --------------------------------------------------------------------


def survivors(edges: DataFrame, items: DataFrame, id_col: str = "id", seen: str = "first_seen_at") -> DataFrame:
    """(absorbed, survivor, pair_score, confidence): each cluster survives as its earliest seen member (then least id).

    edges: (lo, hi, score[, confidence]). pair_score and confidence are those of the strongest edge that touches the
    absorbed item; of edges without a confidence it is null.
    """
    if "confidence" not in edges.columns:
        edges = edges.withColumn("confidence", F.lit(None).cast("string"))
    labels = graph.components(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    members = labels.join(items.select(F.col(id_col).alias("node"), F.col(seen).alias("_seen")), "node")
    first = members.groupBy("label").agg(F.min(F.struct("_seen", "node")).alias("f")).select("label", F.col("f.node").alias("survivor"))
    touch = edges.select(F.explode(F.array("lo", "hi")).alias("node"), "score", "confidence")
    best = F.max(F.struct("score", (F.col("confidence") == "auto").alias("sure"), "confidence"))
    strongest = touch.groupBy("node").agg(best.alias("b")).select("node", F.col("b.score").alias("pair_score"), F.col("b.confidence").alias("confidence"))
    absorbed = members.join(first, "label").where("node <> survivor").select(F.col("node").alias("absorbed"), "survivor")
    return absorbed.join(strongest.withColumnRenamed("node", "absorbed"), "absorbed")


def resolve_batch(items: DataFrame, most: int | None = None, embeddings: bool = False) -> DataFrame:
    """(absorbed, survivor, pair_score, confidence) of items (id, name, domain, people, first_seen_at), names and domains normalised."""
    keys = keyed(items, "id", F.col("name"), F.col("domain"))
    pairs = candidate_pairs(selective(keys, most) if most else keys).union(same_value(items, "id", F.col("domain"))).union(same_value(items, "id", F.col("name"))).distinct()
    edges = score_pairs(pairs, items, "id", embeddings, UNCERTAIN).where(F.col("score") >= UNCERTAIN)
    return survivors(table(edges.select("lo", "hi", "score", "confidence"), "merge-edges"), items)


def canonical(merges: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """(id, root) by following (id, merged_into) for at most ``hops`` steps; a cycle or a longer chain raises.

    Pointer doubling: each round joins the map with itself.
    """
    # a round doubles the steps, so this many rounds follow at least hops steps
    now = merges.select("id", F.col("merged_into").alias("root"), F.lit(1).alias("steps"))
    for _ in range(max(1, hops.bit_length())):
        nxt = now.select(F.col("id").alias("root"), F.col("root").alias("_r"), F.col("steps").alias("_s"))
        now = now.join(nxt, "root", "left").select("id", F.coalesce("_r", "root").alias("root"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps"))
    wrong = F.raise_error(F.concat(F.lit("merge chain is a cycle or too long at "), F.col("id").cast("string")))
    return now.select("id", F.when((F.col("id") == F.col("root")) | (F.col("steps") > hops), wrong.cast(now.schema["root"].dataType)).otherwise(F.col("root")).alias("root"))


# --- fields ----------------------------------------------------------------------


def precedence(source: Column) -> Column:
    """Rank of a source, 0 for the most trusted; unknown sources come last."""
    at = F.array_position(F.array(*[F.lit(s) for s in PRECEDENCE]), source)
    return F.when(at > 0, at - 1).otherwise(len(PRECEDENCE))


def resolve_field(observations: DataFrame, by: list[str], value: str = "value", source: str = "source", observed: str = "observed_at", tie: str = "id") -> DataFrame:
    """The winning observation for each group: trusted source, then latest, then least tie-break."""
    order = F.struct(precedence(F.col(source)).alias("r"), (-F.unix_micros(F.col(observed).cast("timestamp"))).alias("t"), F.col(tie).alias("i"))
    win = F.min_by(F.struct(value, source, observed, tie), order)
    return observations.where(F.col(value).isNotNull()).groupBy(*by).agg(win.alias("w")).select(*by, "w.*")


def provenance(companies: DataFrame, records: DataFrame) -> DataFrame:
    """Five rows for each company: field, value, method, source, source_record_id.

    records: (company_id, id, source, fetched_at, name, domain, description).
    """
    fields = {"canonicalName": ("name", "canonical_name"), "domain": ("domain", "domain"), "description": ("description", "description")}
    seen = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.nullif(F.col(c), F.lit("")).alias("value")) for f, (c, _) in fields.items()]))
    observed = records.select("company_id", "id", "source", "fetched_at", seen.alias("x")).select("company_id", "id", "source", "fetched_at", "x.*")
    won = resolve_field(observed, ["company_id", "field"], observed="fetched_at").select("company_id", "field", F.col("value").alias("_v"), "source", F.col("id").alias("source_record_id"))
    own = [F.struct(F.lit(f).alias("field"), F.col(c).alias("value"), F.lit(True).alias("known")) for f, (_, c) in fields.items()]
    own += [F.struct(F.lit(f).alias("field"), F.col(c).alias("value"), F.lit(False).alias("known")) for f, c in (("sector", "sector"), ("estimatedStage", "estimated_stage"))]
    rows = companies.select(F.col("id").alias("company_id"), F.explode(F.array(*own)).alias("y")).select("company_id", "y.*")
    method = F.when(F.col("known"), "reconstructed").otherwise("enrichment-not-attributable")
    return rows.join(won, ["company_id", "field"], "left").select("company_id", "field", F.coalesce("_v", "value").alias("value"), method.alias("method"), "source", "source_record_id")


# --- quality -----------------------------------------------------------------------


def confusion(rows: DataFrame, said: Column, true: Column) -> DataFrame:
    """tp, fp, fn, tn, precision and recall of a decision; the shares are 1 where there is nothing to find."""
    counts = rows.agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"))
    share = lambda other: F.when(F.col("tp") + F.col(other) > 0, F.round(F.col("tp") / (F.col("tp") + F.col(other)), 6)).otherwise(1.0)
    return counts.select("tp", "fp", "fn", "tn", share("fp").alias("precision"), share("fn").alias("recall"))
