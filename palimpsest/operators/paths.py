"""Longest-prefix path mapping and rule resolution. Prefix joins run as equi-joins on ancestors."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ancestors, path_key, path_syntax, suggest_name, trimmed
from ..sources.scratch import rewritten


def map_paths(paths: DataFrame, rules: DataFrame, source: str = "remote_prefix", target: str = "local_prefix", scope: list[str] | None = None) -> DataFrame:
    """Adds `mapped`: the longest rule prefix on component boundaries replaced; null without a match.

    The suffix keeps its case; separators are the target's. paths: path and the scope columns.
    """
    scope = scope or []
    marked = paths.withColumn("__key", path_key(F.col("path")))
    each = marked.select(*scope, "path", "__key", F.explode(ancestors(F.col("__key"))).alias("__at")).distinct()
    r = rules.select(*scope, path_key(F.col(source)).alias("__at"), F.col(target).alias("__target"))
    best = each.join(r, [*scope, "__at"]).groupBy(*scope, "path", "__key").agg(F.max_by(F.struct("__at", "__target"), F.length("__at")).alias("__rule"))
    rest = F.substr(F.rtrim(path_syntax(F.col("path")), F.lit("/")), F.length("__rule.__at") + 1)
    head = F.rtrim(F.col("__rule.__target"), F.lit("/\\"))
    backslash = F.col("__rule.__target").contains("\\")
    mapped = F.concat(head, F.when(backslash, F.replace(rest, F.lit("/"), F.lit("\\"))).otherwise(rest))
    out = best.select(*(F.col(s).alias(f"__s{i}") for i, s in enumerate(scope)), F.col("path").alias("__p"), mapped.alias("mapped"))
    on = paths["path"] == out["__p"]
    for i, s in enumerate(scope):
        on = on & paths[s].eqNullSafe(out[f"__s{i}"])
    return paths.join(out, on, "left").select(*paths.columns, "mapped")


def canonical_paths(paths: DataFrame, rules: DataFrame, **options) -> DataFrame:
    """map_paths, with unmatched paths as they are."""
    return map_paths(paths, rules, **options).withColumn("mapped", F.coalesce("mapped", "path"))


def ambiguous_rules(rules: DataFrame, scope: list[str]) -> DataFrame:
    """Violations: blank or root prefixes (a drive is none), and keys that two rules of a scope share on one side."""
    sides = [rules.select(*scope, F.lit(s).alias("side"), path_key(F.col(f"{s}_prefix")).alias("key")) for s in ("remote", "local")]
    rows = sides[0].unionByName(sides[1]).groupBy(*scope, "side", "key").agg(F.count(F.lit(1)).alias("n"))
    rule = F.when(F.col("key") == "", "root").when(F.col("n") > 1, "repeated")
    return rows.withColumn("rule", rule).filter("rule IS NOT NULL")


def with_reference_paths(threads: DataFrame, reference: DataFrame) -> DataFrame:
    """A thread's path from the reference set, else its own, else its row's cwd.

    problem: duplicate_reference where the set names the thread more than once; such a reference is not applied.
    """
    known = reference.groupBy("thread_id").agg(F.first("source_path").alias("__known"), (F.count(F.lit(1)) > 1).alias("__twice"))
    rows = threads.join(known, "thread_id", "left")
    path = F.coalesce(F.when(~F.col("__twice"), F.col("__known")), "source_path", "cwd")
    return rows.withColumn("source_path", path).withColumn("problem", F.when(F.col("__twice"), "duplicate_reference")).drop("__known", "__twice")


def path_usage(threads: DataFrame, index: DataFrame, by: list[str]) -> DataFrame:
    """Active and archived threads per path, in its first spelling; index rows without a file count too."""
    both = threads.unionByName(index.join(threads.select("thread_id"), "thread_id", "left_anti"))
    rows = both.filter(trimmed(F.col("path")) != "").withColumn("key", path_key(F.col("path")))
    return rows.groupBy(*by, "key").agg(F.min_by("path", F.col("thread_id")).alias("path"), F.count_if(~F.col("archived")).alias("active"), F.count_if("archived").alias("archived"))


def classify_paths(paths: DataFrame, rules: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct paths as mapped, existing (in the table of known folders) or missing; `listed` marks the missing ones that lie in no other missing one."""
    distinct = paths.withColumn("key", path_key(F.col("path"))).groupBy("key").agg(F.min("path").alias("path"))
    mapped = map_paths(distinct, rules)
    dirs = known.select(path_key(F.col("path")).alias("key"), F.lit(True).alias("exists")).distinct()
    kind = F.when(F.col("mapped").isNotNull(), "mapped").when(F.col("exists"), "existing").otherwise("missing")
    rows = mapped.join(dirs, "key", "left").select("key", "path", kind.alias("kind"))
    roots = minimal_roots(rows.filter("kind = 'missing'").select("path")).select("key", F.lit(True).alias("listed"))
    return rows.join(roots, "key", "left").fillna(False, ["listed"])


def minimal_roots(paths: DataFrame) -> DataFrame:
    """Paths without those that have a listed ancestor."""
    keys = paths.withColumn("key", path_key(F.col("path"))).groupBy("key").agg(F.min("path").alias("path"))
    above = keys.select("key", F.explode(ancestors(F.col("key"), strict=True)).alias("at"))
    covered = above.join(keys.select(F.col("key").alias("at")), "at").select("key").distinct()
    return keys.join(covered, "key", "left_anti")


def path_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b) pairs of keys that are the same, or one inside the other."""
    x, y = a.select(path_key(F.col("path")).alias("a")).distinct(), b.select(path_key(F.col("path")).alias("b")).distinct()
    inside = x.select("a", F.explode(ancestors(F.col("a"))).alias("b")).join(y, "b")
    around = y.select("b", F.explode(ancestors(F.col("b"), strict=True)).alias("a")).join(x, "a")
    kind = F.when(F.col("a") == F.col("b"), "same").otherwise("child")
    return inside.select("a", "b", kind.alias("relation")).unionByName(around.select("a", "b", F.lit("parent").alias("relation")))


def unique_names(df: DataFrame, by: list[str]) -> DataFrame:
    """suggest_name per path, made unique without regard to case: the first keeps it, others get -2, -3...

    A generated name can meet another one, so the pass repeats until none does; each pass
    lengthens all but the first of the names that meet, so it ends.
    """
    named = df.withColumn("name", suggest_name(F.col("path")))
    while True:
        w = Window.partitionBy(*by, F.lower("name")).orderBy("path")
        n = F.row_number().over(w)
        named = rewritten(named.withColumn("name", F.when(n > 1, F.concat("name", F.lit("-"), n.cast("string"))).otherwise(F.col("name"))), "names")
        if not named.groupBy(*by, F.lower("name").alias("l")).count().filter("count > 1").limit(1).count():
            return named


def assign_projects(threads: DataFrame, roots: DataFrame, projects: DataFrame) -> DataFrame:
    """Each thread's project: the longest root that holds it.

    Roots are the mapping roots and paths used by two threads or more or covered by no root; an
    existing project of the same root keeps its id, else local- and 32 hex digits of a hash.
    """
    keyed = threads.withColumn("key", path_key(F.col("path")))
    listed = roots.select(path_key(F.col("path")).alias("root")).distinct()
    used = keyed.groupBy("key").count()
    above = used.select("key", F.explode(ancestors(F.col("key"))).alias("root"))
    covered = above.join(listed, "root").select("key").distinct().withColumn("covered", F.lit(True))
    own = used.join(covered, "key", "left").filter((F.col("count") >= 2) | F.col("covered").isNull()).select(F.col("key").alias("root"))
    known = projects.select(path_key(F.col("path")).alias("root"), "project_id").groupBy("root").agg(F.min("project_id").alias("project_id"))
    all_roots = listed.unionByName(own).distinct().join(known, "root", "left")
    all_roots = all_roots.withColumn("project_id", F.coalesce("project_id", F.concat(F.lit("local-"), F.substring(F.sha2("root", 256), 1, 32))))
    best = above.join(all_roots, "root").groupBy("key").agg(F.max_by("project_id", F.length("root")).alias("project_id"), F.max_by("root", F.length("root")).alias("root"))
    return keyed.join(best, "key").select("thread_id", "root", "project_id")


def explode_projects(state: DataFrame) -> DataFrame:
    """(home, project_id, name, root) rows of a JSON map of projects; the name defaults to the id."""
    entry = F.from_json("body", "map<string, struct<name: string, roots: array<string>>>")
    rows = state.select("home_key", F.explode(entry).alias("project_id", "p"))
    return rows.select("home_key", "project_id", F.coalesce("p.name", "project_id").alias("name"), F.explode("p.roots").alias("root"))


def resolve_namespace(identities: DataFrame, rules: DataFrame) -> DataFrame:
    """The namespace of each identity: off, override, rule, ambiguous or default.

    identities: identity, remote_id, auto, override, default_ns, fingerprint, provider, home_key.
    A rule's set fields must all match; fingerprint scores 4, provider 2, home 1. Rules with the same remote and the
    same set fields are a group, which is told of once: whether its namespaces differ, the first rule's, and, where they
    differ, the ids of its rules. Groups meet the distinct values of identities on one pattern of set fields at a time, an
    equi-join, and identities then look up their values, so no pair of identity and rule is made.
    """
    fields = {"fingerprint": 4, "provider": 2, "home_key": 1}
    masked = [f"__{f}" for f in fields]

    def same(df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
        there = other.select(*(F.col(k).alias(f"__same_{k}") for k in keys), *(c for c in other.columns if c not in keys))
        return df.join(there, reduce(and_, (F.col(k).eqNullSafe(F.col(f"__same_{k}")) for k in keys)), how).drop(*(f"__same_{k}" for k in keys))

    pattern = sum((F.when(F.col(f).isNotNull(), score).otherwise(0) for f, score in fields.items()), F.lit(0))
    keyed = rules.filter("remote_id IS NOT NULL").select("remote_id", *(F.col(f).alias(f"__{f}") for f in fields), pattern.alias("score"), F.col("id").alias("rule_id"), "namespace_id").filter("score > 0")
    by = ["remote_id", *masked, "score"]
    told = [(F.min("namespace_id") != F.max("namespace_id")).alias("several"), F.min("namespace_id").isNotNull().alias("known"), F.min_by("namespace_id", "rule_id").alias("rule_ns")]
    groups = keyed.groupBy(*by).agg(*told)
    ids = same(keyed, groups.filter("several").select(*by), by, "left_semi").groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(F.col("rule_id").cast("string"))), ",").alias("rules"))
    values = ["remote_id", *fields]
    at = [F.when(F.col("score").bitwiseAND(n) > 0, F.col(f)).alias(f"__{f}") for f, n in fields.items()]
    asked = identities.select(*values).distinct().withColumn("score", F.explode(F.array(*map(F.lit, range(1, 8)))))
    hits = same(asked.select(*values, "score", *at), groups, by, "inner")
    best = hits.groupBy(*values).agg(F.max("score").alias("score"), F.max_by(F.struct("several", "known", "rule_ns"), "score").alias("of")).select(*values, "score", "of.*")
    best = same(best.select("*", *at), ids, by, "left").select(*values, "several", "known", "rule_ns", "rules")
    rows = same(identities, best, values, "left")
    kind = (
        F.when(~F.col("auto"), "default").when(F.col("override").isNotNull(), "override").when(F.col("several"), "ambiguous").when(F.col("known"), "rule").when(F.col("default_ns").isNotNull(), "default").otherwise("none")
    )
    rows = rows.withColumn("kind", kind)
    ns = F.when(F.col("kind") == "override", F.col("override")).when(F.col("kind") == "rule", F.col("rule_ns")).when(F.col("kind") == "default", F.col("default_ns"))
    return rows.select("identity", "kind", ns.alias("namespace_id"), F.when(F.col("kind") == "ambiguous", F.col("rules")).alias("rules"))


def dedupe_rules(rules: DataFrame, scope: list[str]) -> DataFrame:
    """Where one key was spelled in several ways, the first rule; all rules elsewhere."""
    keyed = rules.withColumn("key", path_key(F.col("remote_prefix")))
    several = keyed.groupBy(*scope, "key").agg((F.count_distinct("remote_prefix") > 1).alias("several"))
    w = Window.partitionBy(*scope, "key").orderBy("created_at", "id")
    return keyed.withColumn("rn", F.row_number().over(w)).join(several, [*scope, "key"]).filter("NOT several OR rn = 1").drop("rn", "several")


def cleanup_candidates(usage: DataFrame, rules: DataFrame, projects: DataFrame, dirs: DataFrame, protected: DataFrame) -> DataFrame:
    """Per path: active and archived threads, whether a rule covers it (inherited: only one of a folder above), its projects' names, folder state, eligibility.

    projects: path, name. Eligible: no threads, no rule, no overlap with a protected path, and an
    empty folder or a missing one that is listed as a project.
    """
    key = lambda df: df.withColumn("key", path_key(F.col("path")))
    u = key(usage).groupBy("key").agg(F.sum("active").alias("active"), F.sum("archived").alias("archived"))
    p = key(projects).groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("projects"))
    d = key(dirs).groupBy("key").agg(F.min("state").alias("state"))
    all_ = u.join(p, "key", "full").join(d, "key", "full")
    up = all_.select("key", F.explode(ancestors(F.col("key"))).alias("at"))
    covered = up.join(rules.select(path_key(F.col("local_prefix")).alias("at")).distinct(), "at").groupBy("key").agg(F.lit(True).alias("covered"), F.bool_and(F.col("at") != F.col("key")).alias("inherited"))
    touched = path_overlap(all_.select(F.col("key").alias("path")), protected).select(F.col("a").alias("key")).distinct().withColumn("touched", F.lit(True))
    rows = all_.join(covered, "key", "left").join(touched, "key", "left").fillna(False, ["covered", "inherited", "touched"]).fillna(0, ["active", "archived"]).fillna("missing", ["state"])
    empty = (F.col("state") == "empty") | ((F.col("state") == "missing") & F.col("projects").isNotNull())
    return rows.withColumn("eligible", (F.col("active") + F.col("archived") == 0) & ~F.col("covered") & ~F.col("touched") & empty).drop("touched")


def search_paths(entries: DataFrame, wanted: Column, query: str) -> DataFrame:
    """Entries that satisfy `wanted` and hold the query, whatever its case, in path or names."""
    q = query.lower()
    return entries.filter(wanted & (F.lower("path").contains(q) | F.exists("names", lambda n: F.lower(n).contains(q))))
