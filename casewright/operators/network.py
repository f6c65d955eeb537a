"""People who recur together: edges, nodes, and the bipartite graph of people and crime types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import columns as C
from casewright.operators import cases
from casewright.sources.tables import Tables

LEAST_SHARED, LEAST_DEGREE, MOST_PERSONS = 2, 2, 90


#: Persons of a case, beyond which its pairs aren't listed.
HEAVY = 500


def _entries(t: Tables, least: int, among: list[str] | None, shares: int) -> DataFrame:
    """CaseMasterID, PersonID without repeats, of persons (of ``among`` if given) on ``least`` or more cases; no other can be in a pair."""
    named = t["Accused"].filter(F.col("PersonID").isNotNull() if among is None else F.col("PersonID").isin(among)).select("CaseMasterID", "PersonID")
    # entries hardly repeat, so they are dealt out before they are told apart
    seen = named.repartition(shares, "CaseMasterID", "PersonID").distinct()
    often = seen.groupBy("PersonID").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("PersonID")
    return seen.join(often.hint("shuffle_hash"), "PersonID", "left_semi")


def _crowded(entries: DataFrame, heavy: int, shares: int) -> DataFrame:
    """CaseMasterID of cases of more than ``heavy`` persons."""
    return entries.repartition(shares, "CaseMasterID").groupBy("CaseMasterID").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > heavy).select("CaseMasterID")


def _listed(entries: DataFrame, shares: int) -> DataFrame:
    """source, target, n: pairs of persons on common cases, and on how many."""
    dealt = entries.repartition(shares, "CaseMasterID")
    a, b = dealt.withColumnRenamed("PersonID", "source"), dealt.withColumnRenamed("PersonID", "target")
    pairs = a.join(b, "CaseMasterID").filter(F.col("source") < F.col("target")).select("source", "target")
    # most pairs occur once, so they too are dealt out before they are counted
    return pairs.repartition(2 * shares, "source", "target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def _weighed(entries: DataFrame, heavy: DataFrame, shares: int) -> tuple[DataFrame, DataFrame]:
    """Pairs that share a case that isn't heavy (source, target, n, common: heavy cases shared), and each person's heavy cases, sorted."""
    sets = entries.join(heavy, "CaseMasterID", "left_semi").groupBy("PersonID").agg(F.array_sort(F.collect_set("CaseMasterID")).alias("cases"))
    of = lambda end: sets.select(F.col("PersonID").alias(end), F.col("cases").alias(f"of_{end}"))
    pairs = _listed(entries.join(heavy, "CaseMasterID", "left_anti"), shares).join(of("source"), "source", "left").join(of("target"), "target", "left")
    common = F.coalesce(F.size(F.array_intersect("of_source", "of_target")), F.lit(0))
    return pairs.select("source", "target", "n", F.when(F.col("of_source").isNull() | F.col("of_target").isNull(), 0).otherwise(common).alias("common")), sets


def _meeting(rows: DataFrame, ends: tuple[str, str]) -> DataFrame:
    """Rows of ``rows`` (their key and sorted ``cases``) joined with those that share two or more cases, each pair once and in both orders;
    common: how many they share. Rows meet by two cases at a time, and a pair counts where these are the first two that it shares."""
    twos = F.expr("flatten(transform(cases, (x, i) -> transform(slice(cases, i + 2, size(cases)), y -> struct(x AS first, y AS second))))")
    keyed = rows.filter(F.size("cases") > 1).withColumn("two", F.explode(twos))
    a = keyed.select(F.col(rows.columns[0]).alias(ends[0]), F.col("cases").alias("left_cases"), "two", *[F.col(c).alias(f"left_{c}") for c in rows.columns[2:]])
    b = keyed.select(F.col(rows.columns[0]).alias(ends[1]), F.col("cases").alias("right_cases"), "two", *[F.col(c).alias(f"right_{c}") for c in rows.columns[2:]])
    met = a.join(b, "two").withColumn("shared", F.array_intersect("left_cases", "right_cases"))
    return met.filter((F.col("shared")[0] == F.col("two.first")) & (F.col("shared")[1] == F.col("two.second"))).withColumn("common", F.size("shared"))


def strong_pairs(t: Tables, least: int = LEAST_SHARED, among: list[str] | None = None, heavy: int = HEAVY) -> DataFrame:
    """source, target, weight: pairs of persons (source < target), of ``among`` if given, with ``least`` or more distinct cases in common.

    A person counts once in a case, which is settled before any join. Pairs of cases of up to ``heavy`` persons are listed and counted. A
    larger case alone makes no pair strong: pairs that share a smaller one get their larger ones added from both persons' lists, and pairs
    that share none are found by two larger cases at a time, so only pairs that are strong are made of them.
    """
    shares = C.shares(t["Accused"])
    entries = _entries(t, least, among, shares)
    crowded = _crowded(entries, heavy, shares)
    if least < 2 or crowded.isEmpty():
        return _listed(entries, shares).select("source", "target", F.col("n").alias("weight")).filter(F.col("weight") >= least)
    pairs, sets = _weighed(entries, crowded, shares)
    light = pairs.select("source", "target", (F.col("n") + F.col("common")).alias("weight"))
    only_heavy = _meeting(sets, ("source", "target")).filter(F.col("source") < F.col("target")).select("source", "target", F.col("common").cast("bigint").alias("weight"))
    # a pair of both kinds weighs more as the first
    return light.unionByName(only_heavy).groupBy("source", "target").agg(F.max("weight").alias("weight")).filter(F.col("weight") >= least)


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree: how many edges end at each person."""
    ends = edges.select(F.col("source").alias("id")).unionAll(edges.select(F.col("target").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def strong_degrees(t: Tables, least: int = LEAST_SHARED, heavy: int = HEAVY) -> DataFrame:
    """id, degree: in how many strong pairs each person is, as ``degrees(strong_pairs(t))``, without listing pairs of larger cases.

    Persons with the same larger cases are counted as one group, and groups meet instead of persons.
    """
    shares = C.shares(t["Accused"])
    entries = _entries(t, least, None, shares)
    crowded = _crowded(entries, heavy, shares)
    if least < 2 or crowded.isEmpty():
        return degrees(strong_pairs(t, least, heavy=heavy))
    pairs, sets = _weighed(entries, crowded, shares)
    # pairs with two larger cases and enough of them are counted by their groups
    listed = pairs.filter((F.col("n") + F.col("common") >= least) & (F.col("common") < least))
    groups = sets.groupBy(F.col("cases").alias("group"), "cases").agg(F.count(F.lit(1)).alias("persons"))
    near = _meeting(groups, ("group", "other")).filter(F.col("common") >= least).groupBy("group").agg((F.sum("right_persons") - 1).alias("degree"))
    by_group = sets.join(near, sets["cases"] == near["group"]).select(F.col("PersonID").alias("id"), "degree")
    return degrees(listed).unionByName(by_group).groupBy("id").agg(F.sum("degree").alias("degree")).filter(F.col("degree") > 0)


def edges(t: Tables, most: int = MOST_PERSONS) -> DataFrame:
    """Strong pairs among the ``most`` persons of highest degree, of those of degree 2 or more; heaviest first.

    Persons of equal degree enter by id. The list of these few persons is found first, without listing the pairs of larger cases, and
    then only the entries of the listed persons are read into pairs.
    """
    clustered = strong_degrees(t).filter(F.col("degree") >= LEAST_DEGREE).orderBy(F.desc("degree"), "id").limit(most)
    shown = [r.id for r in clustered.collect()]
    return strong_pairs(t, among=shown).select("source", "target", "weight").orderBy(F.desc("weight"), "source", "target")


def nodes(t: Tables, shown: DataFrame) -> DataFrame:
    """id, name, case_count, crime_group, degree of the persons of ``shown`` edges; degree counts shown edges only.

    The name is the greatest of the person's, or the id; the crime group the commonest on the person's entries, of
    equally common ones the first by name, or Unknown. No edges, no nodes.
    """
    rows = t["Accused"].select("CaseMasterID", F.col("PersonID").alias("id"), "AccusedName").join(degrees(shown), "id")
    grouped = cases.attach(t, rows.join(t["CaseMaster"].select("CaseMasterID", "CrimeMajorHeadID"), "CaseMasterID", "left"), "head", how="left")
    # a case has one group, so cases are counted once each however the groups are summed; the shown edges are computed once
    by_case = grouped.groupBy("id", "CaseMasterID", "CrimeGroupName").agg(F.count(F.lit(1)).alias("n"), F.max("AccusedName").alias("name"), F.max("degree").alias("degree"))
    by_group = by_case.groupBy("id", "CrimeGroupName").agg(F.sum("n").alias("n"), F.count("CaseMasterID").alias("cases"), F.max("name").alias("name"), F.max("degree").alias("degree"))
    commonest = F.min(F.when(F.col("CrimeGroupName").isNotNull(), F.struct(-F.col("n"), F.col("CrimeGroupName").alias("group"))))["group"]
    found = by_group.groupBy("id").agg(F.max("name").alias("name"), F.sum("cases").alias("case_count"), commonest.alias("crime_group"), F.max("degree").alias("degree"))
    return found.select("id", F.coalesce("name", "id").alias("name"), "case_count", F.coalesce("crime_group", F.lit("Unknown")).alias("crime_group"), "degree")


# Names under which results carry a person, a number of cases and crime types, in the order of preference.
NAME_COLUMNS = ["AccusedName", "accused_name", "accusedname"]
COUNT_COLUMNS = ["case_count", "CaseCount", "cases", "total"]
TYPE_COLUMNS = ["crime_types", "CrimeGroupName", "crime_type"]


def galaxy(rows: DataFrame, order: list[Column], shown: int = 80, priority: int = 10) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, kind, count, crime_types, priority) and edges (source, target) of people around crime types.

    Of the first ``shown`` rows, as ordered, the first of each name stands for it, with its edges; names that are missing
    are Unknown, counts 1. Crime types of all these rows are hubs. The first ``priority`` places are flagged.
    """

    def pick(names: list[str], default: Column) -> Column:
        return F.coalesce(*[F.col(c).cast("string") for c in names if c in rows.columns], default)

    # the first rows are found without a global order of the others
    placed = rows.orderBy(*order).limit(shown).select(
        F.row_number().over(Window.orderBy(*order)).alias("place"),
        pick(NAME_COLUMNS, F.lit("Unknown")).alias("name"),
        pick(COUNT_COLUMNS, F.lit("1")).cast("double").alias("count"),
        C.split_list(pick(TYPE_COLUMNS, F.lit(""))).alias("types"),
    )
    people = C.top_per_group(placed, ["name"], [F.col("place")])
    hubs = placed.select(F.explode("types").alias("hub")).distinct()
    made = hubs.select(F.concat(F.lit("crime_"), "hub").alias("id"), F.col("hub").alias("label"), F.lit("crime").alias("kind"), F.lit(None).cast("double").alias("count"), F.lit(None).cast("string").alias("crime_types"), F.lit(0).alias("priority"))
    named = people.select(F.col("name").alias("id"), C.first_words(F.col("name")).alias("label"), F.lit("accused").alias("kind"), "count", F.array_join("types", ", ").alias("crime_types"), (F.col("place") <= priority).cast("int").alias("priority"))
    links = people.select(F.col("name").alias("source"), F.explode("types").alias("hub")).select("source", F.concat(F.lit("crime_"), "hub").alias("target"))
    return made.unionByName(named), links


def flagged(found: DataFrame, hub: int = 3) -> DataFrame:
    """Nodes with a flag for those that ``hub`` or more edges end at."""
    return found.withColumn("hub", F.col("degree") >= hub)
