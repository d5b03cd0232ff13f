"""Canonical entities from source files: routing, projection, natural keys, minting, merging, edges, provenance.

Every step is a table with a row for each source row, cell, reference or entity, so the build is a few
aggregations by (entity, key); what the sources mean is a ``Model``, which is configuration.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import null_class, squeeze
from lumenfold.operators.integrate import disposition, merge_field, natural_key
from lumenfold.storage import bounded, written


@dataclass(frozen=True)
class Model:
    """routes: file to entity. columns: (entity, column) to (target, part), where part is FIELD, ATTRIBUTE, PROVENANCE or EDGE.

    edges: (entity, target) to (relation, entity referred to, separator of several or None). keys: an
    entity's natural keys, the best first, each a list of columns. labels: the field that names an
    entity. policies: how a field is merged, COALESCE by default. prefixes: of an entity's ids.
    """

    routes: dict[str, str]
    columns: dict[tuple[str, str], tuple[str, str]]
    edges: dict[tuple[str, str], tuple[str, str, str | None]]
    keys: dict[str, list[list[str]]]
    labels: dict[str, str]
    prefixes: dict[str, str]
    policies: dict[str, str] = field(default_factory=dict)

    def check(self) -> list[str]:
        """What in the model contradicts itself; empty for a sound one."""
        entities = {*self.routes.values(), *(e[1] for e in self.edges.values())}
        wrong = [f"entity {e} has no prefix" for e in sorted(entities) if e not in self.prefixes]
        wrong += [f"entity {e} has no key" for e in sorted(set(self.routes.values())) if not self.keys.get(e)]
        wrong += [f"edge column {e}.{t} is not mapped" for e, t in self.edges if (t, "EDGE") not in [v for k, v in self.columns.items() if k[0] == e]]
        wrong += [f"column {c} of {e} is an edge without a relation" for (e, c), (t, part) in self.columns.items() if part == "EDGE" and (e, t) not in self.edges]
        return wrong + [f"prefix {p} is used twice" for p in sorted(set(self.prefixes.values())) if list(self.prefixes.values()).count(p) > 1]


def _key(c: Column) -> Column:
    return F.lower(squeeze(c))


def project(df: DataFrame, file_id: str, row_no: str, model: Model) -> DataFrame:
    """(entity, file_id, row_no, key, flag, label, parts) of each row of one file.

    parts: (target, part, value, class) of each cell; a column that the model doesn't know is an attribute
    of its own name.
    """
    entity = model.routes[file_id]
    cells = []
    for c in df.columns:
        if c != row_no:
            target, part = model.columns.get((entity, c), (c, "ATTRIBUTE"))
            text = F.col(c).cast("string")
            cells.append(F.struct(F.lit(target).alias("target"), F.lit(part).alias("part"), squeeze(text).alias("value"), null_class(text).alias("class")))
    filled = lambda c: F.when(null_class(F.col(c).cast("string")) == "POPULATED", F.col(c).cast("string"))
    key = natural_key([[filled(c) for c in alternative] for alternative in model.keys[entity]], F.concat_ws(":", F.lit(file_id), F.col(row_no).cast("string")))
    label = next((c for (e, c), (t, _) in model.columns.items() if e == entity and t == model.labels.get(entity) and c in df.columns), None)
    out = df.select(F.lit(entity).alias("entity"), F.lit(file_id).alias("file_id"), F.col(row_no).cast("long").alias("row_no"), key.alias("k"), (squeeze(F.col(label)) if label else F.lit("")).alias("label"), F.array(*cells).alias("parts"))
    return out.select("entity", "file_id", "row_no", "k.key", "k.flag", "label", "parts")


def project_all(files: dict[str, tuple[DataFrame, str]], model: Model) -> DataFrame:
    """The rows of all files, each a table and the column that numbers its rows."""
    return reduce(DataFrame.unionByName, [project(df, file_id, row_no, model) for file_id, (df, row_no) in files.items()])


def contributions(rows: DataFrame) -> DataFrame:
    """(entity, key, target, value, file_id, row_no): what each row says of a field."""
    each = rows.select("entity", "key", "file_id", "row_no", F.explode("parts").alias("p")).where("p.part = 'FIELD' AND p.class = 'POPULATED'")
    return each.select("entity", "key", "p.target", "p.value", "file_id", "row_no")


def references(rows: DataFrame, model: Model) -> DataFrame:
    """(entity, key, relation, to_entity, to_key, value, file_id, row_no): one row for each entity that a row refers to."""
    each = rows.select("entity", "key", "file_id", "row_no", F.explode("parts").alias("p")).where("p.part = 'EDGE' AND p.class = 'POPULATED'")
    found = []
    for (entity, target), (relation, to, separator) in model.edges.items():
        own = each.where((F.col("entity") == entity) & (F.col("p.target") == target))
        members = F.split("p.value", separator) if separator else F.array("p.value")
        found.append(own.select("entity", "key", F.lit(relation).alias("relation"), F.lit(to).alias("to_entity"), F.explode(members).alias("value"), "file_id", "row_no"))
    every = reduce(DataFrame.unionByName, found).withColumn("value", squeeze(F.col("value"))).withColumn("to_key", _key(F.col("value")))
    return every.where("to_key <> ''").select("entity", "key", "relation", "to_entity", "to_key", "value", "file_id", "row_no")


def mint(rows: DataFrame, refs: DataFrame, model: Model, width: int = 5) -> DataFrame:
    """(entity, key, id, direct): an id for each entity that has a row or is referred to, numbered by key within its entity.

    Keys are dealt by range and each range is numbered alone, so no entity's keys are in one task.
    """
    own = rows.select("entity", "key", F.lit(True).alias("direct"))
    keys = own.unionByName(refs.select(F.col("to_entity").alias("entity"), F.col("to_key").alias("key"), F.lit(False).alias("direct"))).groupBy("entity", "key").agg(F.max("direct").alias("direct"))
    ranged = written(keys.repartitionByRange("entity", "key").withColumn("part", F.spark_partition_id()), "keys")
    sizes = ranged.groupBy("entity", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("entity").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("before", before).drop("n")
    nth = F.row_number().over(Window.partitionBy("entity", "part").orderBy("key"))
    numbered = ranged.withColumn("nth", nth).join(bounded(starts), ["entity", "part"])
    prefix = F.element_at(F.create_map(*[F.lit(x) for pair in model.prefixes.items() for x in pair]), F.col("entity"))
    number = (F.col("before") + F.col("nth")).cast("string")
    return numbered.select("entity", "key", F.concat(prefix, F.lit("-"), F.when(F.length(number) >= width, number).otherwise(F.lpad(number, width, "0"))).alias("id"), "direct")


def merged_fields(rows: DataFrame, refs: DataFrame, model: Model) -> DataFrame:
    """(entity, key, target, value, distinct_values, contributions, conflicts): each field by its policy.

    An entity that is only referred to is named by what refers to it.
    """
    label = F.element_at(F.create_map(*[F.lit(x) for pair in model.labels.items() for x in pair]), F.col("to_entity"))
    named = refs.select(F.col("to_entity").alias("entity"), F.col("to_key").alias("key"), label.alias("target"), "value", "file_id", "row_no").where("target IS NOT NULL")
    every = contributions(rows).unionByName(named)
    fields = {target for target, part in model.columns.values() if part == "FIELD"} | set(model.labels.values())
    made = []
    for policy in sorted({model.policies.get(t, "COALESCE") for t in fields}):
        own = [t for t in fields if model.policies.get(t, "COALESCE") == policy]
        made.append(merge_field(every.where(F.col("target").isin(own)), ["entity", "key", "target"], ["file_id", "row_no"], policy))
    return reduce(DataFrame.unionByName, made)


def masters(rows: DataFrame, refs: DataFrame, ids: DataFrame, model: Model) -> DataFrame:
    """(entity, id, key, label, fields, source_rows, source_files, conflict_count, completeness, disposition) of each entity."""
    merged = merged_fields(rows, refs, model)
    fields = merged.groupBy("entity", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "value")))).alias("fields"), F.sum((F.col("conflicts") > 0).cast("long")).alias("conflict_count"))
    sources = rows.groupBy("entity", "key").agg(F.count(F.lit(1)).alias("source_rows"), F.count_distinct("file_id").alias("source_files"), F.max(F.col("flag") != "").alias("unkeyed"))
    out = ids.join(fields, ["entity", "key"], "left").join(sources, ["entity", "key"], "left").na.fill({"conflict_count": 0, "source_rows": 0, "source_files": 0, "unkeyed": False})
    counts = {}
    for (entity, _), (target, part) in model.columns.items():
        if part == "FIELD":
            counts.setdefault(entity, set()).add(target)
    for entity in model.prefixes:
        counts.setdefault(entity, set()).update([model.labels[entity]] if entity in model.labels else [])
    n_fields = F.element_at(F.create_map(*[x for e, t in counts.items() for x in (F.lit(e), F.lit(len(t)))]), F.col("entity"))
    label = F.element_at(F.create_map(*[F.lit(x) for pair in model.labels.items() for x in pair]), F.col("entity"))
    state = disposition(F.col("source_rows") > 1, F.col("conflict_count") > 0, F.col("unkeyed"), F.lit(False))
    filled = F.coalesce(F.size("fields"), F.lit(0))
    return out.select("entity", "id", "key", F.coalesce(F.try_element_at("fields", label), F.lit("")).alias("label"), "fields", "source_rows", "source_files", "conflict_count", F.round(100 * filled / F.greatest(n_fields, F.lit(1)), 2).alias("completeness"), state.alias("disposition"))


def edges(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """(relation, source_id, target_id, evidence): each different edge once, with how many rows state it."""
    end = lambda side, k, name: ids.select(F.col("entity").alias(side), F.col("key").alias(k), F.col("id").alias(name))
    distinct = refs.groupBy("relation", "entity", "key", "to_entity", "to_key").agg(F.count(F.lit(1)).alias("evidence"))
    return distinct.join(end("entity", "key", "source_id"), ["entity", "key"]).join(end("to_entity", "to_key", "target_id"), ["to_entity", "to_key"]).select("relation", "source_id", "target_id", "evidence")


def first_references(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """(entity, key, relation, target_id): the entity that the first row of each key refers to."""
    first = refs.groupBy("entity", "key", "relation", "to_entity").agg(F.min(F.struct("file_id", "row_no", "to_key")).alias("f"))
    target = ids.select(F.col("entity").alias("to_entity"), F.col("key").alias("to_key"), F.col("id").alias("target_id"))
    return first.withColumn("to_key", F.col("f.to_key")).join(target, ["to_entity", "to_key"]).select("entity", "key", "relation", "target_id")


def source_cells(rows: DataFrame, refs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, target, file_id, row_no, value, kind): where every value of an entity comes from.

    An entity without a row of its own has the rows that refer to it, marked REFERENCE.
    """
    own = rows.select("entity", "key", "file_id", "row_no", F.explode("parts").alias("p")).where("p.class = 'POPULATED'").select("entity", "key", "p.target", "file_id", "row_no", "p.value", F.lit("ROW").alias("kind"))
    named = ids.select("entity", "key", "id", "direct")
    told = refs.select(F.col("to_entity").alias("entity"), F.col("to_key").alias("key"), F.col("relation").alias("target"), "file_id", "row_no", "value", F.lit("REFERENCE").alias("kind"))
    return own.unionByName(told).join(named, ["entity", "key"]).where("kind = 'ROW' OR NOT direct").select("id", "target", "file_id", "row_no", "value", "kind")
