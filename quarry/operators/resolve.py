"""Where an import leads: members, parent modules and stubs in turn; packages and prefixes of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def module_of(path: Column) -> Column:
    """The dotted name of a Python file, of a package that of its folder."""
    plain = F.regexp_replace(F.regexp_replace(path, r"\.pyi?$", ""), "(^|/)__init__$", "")
    return F.replace(plain, F.lit("/"), F.lit("."))


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (module, name) with the ``path`` they lead to and how: the member as a module, else its parent; of equal modules a source before a stub.

    Two equi-joins with the table of modules; what neither finds has no path.
    """
    rank = F.when(F.col("path").endswith(".pyi"), 1).otherwise(0)
    modules = files.select(module_of(F.col("path")).alias("m"), F.struct(rank.alias("rank"), "path").alias("f")).groupBy("m").agg(F.min("f").alias("f")).select("m", F.col("f.path").alias("path"))
    member = F.when(F.col("name").isNotNull(), F.concat_ws(".", "module", "name")).otherwise(F.col("module"))
    asked = imports.withColumn("member", member)
    one = modules.select(F.col("m").alias("member"), F.col("path").alias("by_member"))
    two = modules.select(F.col("m").alias("module"), F.col("path").alias("by_parent"))
    found = asked.join(one, "member", "left").join(two, "module", "left")
    how = F.when(F.col("by_member").isNotNull(), "member").when(F.col("by_parent").isNotNull(), "parent").otherwise("unresolved")
    return found.select(*imports.columns, F.coalesce("by_member", "by_parent").alias("path"), how.alias("how"))


def stub_sources(files: DataFrame) -> DataFrame:
    """(stub, source): stubs with the source of the same module beside them; null where there is none."""
    stubs = files.filter("path like '%.pyi'").select(F.col("path").alias("stub"), F.regexp_replace("path", "i$", "").alias("source"))
    return stubs.join(files.select(F.col("path").alias("source"), F.lit(True).alias("there")), "source", "left").select("stub", F.when(F.col("there"), F.col("source")).alias("source"))


def package_root(files: DataFrame) -> DataFrame:
    """(path, root): the topmost folder of the unbroken chain of packages around each file; its own folder if that is no package."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    packages = files.filter("path like '%/__init__.py'").select(folder.alias("at")).distinct()
    named = files.select("path", folder.alias("folder"))
    parts = F.split("folder", "/")
    each = named.select("folder").distinct().select("folder", F.explode(F.expr("transform(sequence(1, size(split(folder, '/'))), i -> struct(i as depth, array_join(slice(split(folder, '/'), 1, i), '/') as at))")).alias("u")).select("folder", "u.*")
    marked = each.join(packages.withColumn("is", F.lit(True)), "at", "left")
    # The lowest folder that is no package ends the chain.
    broken = marked.groupBy("folder").agg(F.max(F.when(F.col("is").isNull(), F.col("depth"))).alias("broken"), F.max("depth").alias("deep"))
    top = F.when(F.coalesce("broken", F.lit(0)) == F.col("deep"), F.col("deep")).otherwise(F.coalesce("broken", F.lit(0)) + 1)
    return named.join(broken, "folder").select("path", F.array_join(F.slice(parts, F.lit(1), top), "/").alias("root"))


def under(prefixes: DataFrame, files: DataFrame) -> DataFrame:
    """(prefix, n): how many files stand under each folder (prefix), by an equi-join on the folders above each file."""
    above = files.select(F.explode(F.expr("transform(sequence(1, size(split(path, '/')) - 1), i -> array_join(slice(split(path, '/'), 1, i), '/'))")).alias("prefix"))
    counted = above.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    return prefixes.join(counted, "prefix", "left").select("prefix", F.coalesce("n", F.lit(0)).alias("n"))


def refined(events: DataFrame, state: DataFrame) -> DataFrame:
    """Deletes of an unknown kind told apart by the cached state (path, is_folder) before the batch: file, folder, or nothing known."""
    joined = events.join(state.select("path", "is_folder"), "path", "left")
    kind = F.when(F.col("kind") != "deleted", F.col("kind")).when(F.col("is_folder"), "deleted_folder").when(F.col("is_folder") == F.lit(False), "deleted_file").otherwise("rescan")
    return joined.select(*[c for c in events.columns if c != "kind"], kind.alias("kind"))


def taint_reasons(calls: DataFrame, direct: DataFrame) -> DataFrame:
    """(head, reason): the first taint of its own in clause order, else the first tainted callee; ``calls`` has caller, pos, callee and ``direct`` head, pos, reason."""
    from quarry.operators.graph import tainted

    reached = tainted(calls.select("caller", "callee"), direct.select("head"))
    own = direct.groupBy("head").agg(F.min_by("reason", "pos").alias("own"))
    callee = calls.join(reached.select(F.col("head").alias("callee")), "callee").groupBy(F.col("caller").alias("head")).agg(F.min_by("callee", F.struct("pos", "callee")).alias("through"))
    found = reached.select("head").join(own, "head", "left").join(callee, "head", "left")
    return found.select("head", F.coalesce("own", F.concat(F.lit("calls "), "through")).alias("reason"))


def without_unused_imports(files: DataFrame, unused: DataFrame) -> DataFrame:
    """``files`` (path, text) without the lines of imports of which nothing is used; ``unused`` has path, row."""
    rows = unused.groupBy("path").agg(F.collect_set("row").alias("rows"))
    kept = F.expr("array_join(transform(filter(transform(split(text, '\\n', -1), (x, i) -> struct(x, i)), s -> rows is null or not array_contains(rows, s.i + 1)), s -> s.x), '\\n')")
    return files.join(rows.hint("merge"), "path", "left").select("path", kept.alias("text"))
