"""Annotated matrices on disk: entries, annotations, groups and shards of one layout, with a manifest that answers without a scan.

Tables of a dataset: obs, var, one per family of entries (x, raw, layers, modalities), groups, shards, digests, and for each key of
obsm, varm, obsp and varp one. Entries are sorted by row_id, so ranges and requests prune by Parquet's statistics.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.errors import DatasetCorrupt, IncompatibleSchema
from lattica.functions import dtypes, runtime
from lattica.operators import combine, layout, select, structure
from lattica.sources import store


@dataclasses.dataclass
class Matrix:
    """An annotated matrix as tables: obs(row_id, ...), var(col_id, ...), families of (row_id, col_id, value), obsm and varm of (row_id or
    col_id, vec), obsp and varp of (src, dst, weight), uns as plain values."""

    obs: DataFrame
    var: DataFrame
    families: dict[str, DataFrame]
    value_dtype: str = "float64"
    obsm: dict[str, DataFrame] = dataclasses.field(default_factory=dict)
    varm: dict[str, DataFrame] = dataclasses.field(default_factory=dict)
    obsp: dict[str, DataFrame] = dataclasses.field(default_factory=dict)
    varp: dict[str, DataFrame] = dataclasses.field(default_factory=dict)
    uns: dict = dataclasses.field(default_factory=dict)

    def parts(self) -> Iterator[tuple[str, str, DataFrame]]:
        for kind in ("obsm", "varm", "obsp", "varp"):
            for key, df in getattr(self, kind).items():
                yield kind, key, df


def moved(df: DataFrame, perm: DataFrame, *columns: str) -> DataFrame:
    """df with row ids of the input in `columns` as those of the layout. perm(was, row_id)."""
    names = df.columns
    for c in columns:
        df = df.withColumnRenamed(c, "_was").join(perm.select(F.col("was").alias("_was"), F.col("row_id").alias(c)), "_was").drop("_was")
    return df.select(*names)


def write(
    spark: SparkSession, path: str, m: Matrix, *, group_by: str | None = None, reference=None, sort_within_group: Sequence[str] = (), sort_order: str | None = None, codec: str | None = None,
    data_dtype: str | None = None, target_bytes: int = 1 << 30, min_bytes: int | None = None, max_bytes: int | None = None, unique: bool = True, checksum: bool = True, overwrite: bool = False,
    entry_bytes: int | None = None, layout_only: Sequence[str] = (),
) -> Archive:
    """Writes a matrix in its layout. What it is told and what it holds is checked before anything is written.

    Counts that aren't whole, or negative ones, make a fractional source fall back to float; nothing else does. A grouped layout has the
    reference first and whole groups in a shard; an ungrouped one keeps the order of the input and is cut evenly. Shards are sized by
    `entry_bytes` an entry; by default that follows from the values and the number of columns. Columns of obs in `layout_only` aren't kept.

    The entries are brought into their layout once, a row's as one array; checks, shards, digests and the table of entries are read from
    that without another shuffle.
    """
    layout.check_sort(group_by, list(sort_within_group), sort_order)
    layout.size_band(target_bytes, least=min_bytes, most=max_bytes)
    if reference is not None and group_by is None:
        raise ValueError("a reference needs group_by")
    m = dataclasses.replace(m, obs=m.obs.drop(*{"label", "role"} - {group_by}))  # of an earlier layout
    n_vars = m.var.count()
    if group_by is None:
        placed = m.obs.select("*", F.lit(layout.MISSING).alias("label"), F.lit("group").alias("role"), F.col("row_id").alias("_was"))
        spans = placed.limit(0).select(F.lit(0).cast("long").alias("ord"), "label", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop"), "role")
    else:
        obs = runtime.saved(layout.with_reference(m.obs.withColumnRenamed("row_id", "_was"), reference, label=group_by, position="_was"))
        layout.check_reference(obs, group_by)
        placed = layout.storage_order(obs, label=group_by, position="_was", secondary=list(sort_within_group), sort_order=sort_order or "natural").drop("is_ref")
        spans = layout.group_spans(placed)
    placed = runtime.saved(placed)
    spans = runtime.saved(spans)
    perm = placed.select(F.col("_was").alias("was"), "row_id", "label")
    n_obs = placed.count()
    tasks = {k: structure.tasks_for(df) for k, df in m.families.items()}
    laid = runtime.saved(structure.in_layout(structure.row_cells(m.families["x"], tasks["x"]).withColumnRenamed("row_id", "was").join(perm, "was", "full_outer"), tasks["x"]))
    given = structure.cells_of(laid.withColumn("row_id", F.col("was")), m.families["x"].columns)
    structure.check_entries(given, n_vars, unique=False)
    if unique:
        twice = laid.where(F.size(F.array_distinct("cells.col_id")) < F.size("cells"))
        structure.check_entries(structure.cells_of(twice.withColumn("row_id", F.col("was")), m.families["x"].columns), n_vars)
    stats = runtime.saved(dtypes.value_stats(given))
    codec = dtypes.decide_codec(dtypes.count_faults(stats).first()[0], m.value_dtype, codec)
    minimal = dtypes.min_dtype(stats).first()[0]
    value = dtypes.float_width(m.value_dtype, data_dtype) if codec == "float" else data_dtype or (minimal if minimal in ("uint16", "uint32") else "uint16")
    rows = laid.where("row_id is not null")
    entries = {"x": dtypes.cast_values(structure.cells_of(rows, m.families["x"].columns), m.value_dtype, value)}
    for k, df in m.families.items():
        if k != "x":
            entries[k] = structure.cells_of(structure.in_layout(structure.row_cells(df, tasks[k]).withColumnRenamed("row_id", "was").join(perm, "was"), tasks[k]), df.columns)
    nnz = rows.select("row_id", "label", F.when(F.col("cells").isNull(), 0).otherwise(F.size("cells")).cast("long").alias("nnz"))
    total = nnz.agg(F.coalesce(F.sum("nnz"), F.lit(0))).first()[0]
    each = entry_bytes or dtypes.bytes_per_entry(minimal, n_vars)
    if group_by is None:
        bounds = layout.split_even(spark.range(1).select(F.lit(n_obs).alias("n")), layout.shard_count(total, each, target_bytes, n_obs))
        members = spans.select("label", "ord", F.lit(0).cast("long").alias("shard"))
    else:
        members = runtime.saved(layout.pack_shards(layout.group_bytes(spans, nnz, each), target=target_bytes))
        bounds = layout.shard_bounds(members, spans)
    sized = layout.shard_of_rows(nnz.select("row_id", "nnz"), bounds).groupBy("shard").agg(F.sum("nnz").cast("long").alias("nnz"))
    shards = bounds.join(sized, "shard", "left").select("shard", "row_start", "row_stop", F.coalesce("nnz", F.lit(0).cast("long")).alias("nnz"))
    tables = {"obs": placed.drop("_was", *layout_only, *(("label", "role") if group_by is None else ())), "var": m.var, "groups": spans, "members": members, "shards": shards.withColumn("bytes", F.col("nnz") * each)}
    tables |= {combine.family_folder(k): df for k, df in entries.items()}
    if checksum:
        tables["digests"] = rows.where("cells is not null").select("row_id", structure.digest_of("cells", dtypes.SPARK[value]).alias("sha256"))
    for kind, key, df in m.parts():
        tables[f"{kind}.{key}"] = moved(df, perm, *{"obsm": ("row_id",), "obsp": ("src", "dst")}.get(kind, ()))
    about = {
        "n_obs": n_obs, "n_vars": n_vars, "nnz": total, "codec": codec, "value_dtype": value, "min_dtype": minimal, "index_dtype": "uint16" if n_vars <= 65536 else "uint32", "group_by": group_by,
        "reference": sorted(r[0] for r in spans.where("role = 'reference'").select("label").collect()), "sort_within_group": list(sort_within_group), "sort_order": sort_order,
        "families": list(m.families), "uns": m.uns, "checksum": checksum,
    }
    # what is in the order of rows already; placed is, where numbered() made it
    as_it_is = {"digests", *map(combine.family_folder, entries), *(("obs",) if group_by is not None else ())}
    store.write(spark, path, tables, overwrite=overwrite, about=about, as_it_is=as_it_is)
    return Archive(spark, path)


def open_(spark: SparkSession, path: str) -> Archive:
    """The archive at a path, its manifest and group records checked; entries aren't read."""
    a = Archive(spark, path)
    a.check()
    return a


class Archive:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.data = spark, store.Dataset(spark, path)
        self.about = self.data.manifest()

    # --- what the manifest and the annotations tell

    @property
    def shape(self) -> tuple[int, int]:
        return self.about["n_obs"], self.about["n_vars"]

    @property
    def is_grouped(self) -> bool:
        return self.about["group_by"] is not None

    @property
    def uns(self) -> dict:
        return self.about["uns"]

    @property
    def matrices(self) -> list[str]:
        return self.about["families"]

    @property
    def modalities(self) -> list[str]:
        return [k.split(":", 1)[1] for k in self.matrices if k.startswith("modality:")]

    def info(self) -> DataFrame:
        """One row from the manifest: n_obs, n_vars, nnz, codec, value_dtype, index_dtype, group_by."""
        names = ("n_obs", "n_vars", "nnz", "codec", "value_dtype", "index_dtype", "group_by")
        return self.spark.createDataFrame([tuple(self.about[n] for n in names)], "n_obs long, n_vars long, nnz long, codec string, value_dtype string, index_dtype string, group_by string")

    def table(self, name: str) -> DataFrame:
        return self.data.table(name)

    def obs(self) -> DataFrame:
        return self.table("obs")

    def var(self) -> DataFrame:
        return self.table("var")

    def keys(self, kind: str) -> list[str]:
        return sorted(t.split(".", 1)[1] for t in self.about["tables"] if t.startswith(f"{kind}."))

    def part(self, kind: str, key: str) -> DataFrame:
        return self.table(f"{kind}.{key}")

    def check(self) -> None:
        """Group records tile the rows, the reference is a leading run, shards tile them too, and the manifest agrees."""
        n = self.about["n_obs"]
        if self.is_grouped and n:
            spans = self.table("groups")
            if spans.isEmpty() or not structure.tiling_faults(spans, F.lit(n)).isEmpty():
                raise DatasetCorrupt("groups don't tile the rows")
            later = spans.where("role = 'group'").agg(F.min("start")).first()[0]
            if not spans.where("role = 'reference'").where(F.col("start") >= F.lit(n if later is None else later)).isEmpty():
                raise DatasetCorrupt("the reference doesn't lead")
            if sorted(r[0] for r in spans.where("role = 'reference'").select("label").collect()) != self.about["reference"]:
                raise DatasetCorrupt("the manifest names another reference")
        shards = self.table("shards").select(F.col("shard").cast("string").alias("label"), F.col("row_start").alias("start"), F.col("row_stop").alias("stop"))
        if n and (shards.isEmpty() or not structure.tiling_faults(shards, F.lit(n)).isEmpty()):
            raise DatasetCorrupt("shards don't tile the rows")

    # --- groups

    def group_spans(self) -> DataFrame:
        return self.table("groups")

    def reference_row_count(self) -> int | None:
        return select.reference_count(self.group_spans()).first()[0]

    # --- entries

    def family(self, key: str = "x") -> DataFrame:
        if key not in self.matrices:
            raise KeyError(f"no family {key!r}; there are {self.matrices}")
        return self.table(combine.family_folder(key))

    def layer(self, name: str, modality: str | None = None) -> DataFrame:
        return self.family(combine.family_key("layer", name, f"modality:{modality}" if modality else "x"))

    def modality(self, name: str) -> DataFrame:
        return self.family(combine.family_key("modality", name))

    def resolved(self, *, matrix: str | None = None, layer: str | None = None, modality: str | None = None) -> DataFrame:
        """One family by its key, or by a layer's name within the scope of a modality; not by both."""
        if matrix is not None and layer is not None:
            raise ValueError("matrix and layer exclude each other")
        if layer is not None:
            return self.layer(layer, modality)
        return self.modality(modality) if modality is not None and matrix is None else self.family(matrix or "x")

    def read(self, *, data: str | None = None, index: str | None = None, cast_back: bool = True, allow_lossy: bool = False, family: str = "x") -> DataFrame:
        """All entries in the types of read_plan()."""
        m = self.about
        plan = dtypes.read_plan(m["value_dtype"], m["min_dtype"], m["nnz"], m["n_vars"], data=data, index=index, cast_back=cast_back)
        return dtypes.cast_values(self.family(family), m["value_dtype"], plan["data"], allow_lossy=allow_lossy, safe=plan["safe"])

    def pushed(self, ids: Sequence[int], df: DataFrame) -> DataFrame:
        """df of the rows from the least to the largest id, which the scan prunes by; short lists prune by each id."""
        if not len(ids):
            return df.limit(0)
        if len(ids) <= 1000:
            return df.where(F.col("row_id").isin(sorted({int(i) for i in ids})))
        return df.where((F.col("row_id") >= min(ids)) & (F.col("row_id") <= max(ids)))

    def gather(self, request, *, ordered: bool = True, data: str | None = None) -> DataFrame:
        """pos, row_id, col_id, value of a request (an id, ids, or a mask), in its order or in that of the rows. Values as float32 unless
        the archive holds float64 or `data` names a type."""
        ids = select.row_ids(request, self.about["n_obs"])
        stored = self.about["value_dtype"]
        target = data or ("float64" if stored == "float64" else "float32")
        x = dtypes.cast_values(self.pushed(ids, self.family()), stored, target, allow_lossy=data is None)
        return select.gather(x, select.request_table(self.spark, ids if ordered else sorted(ids)))

    def rows(self, start: int, stop: int, family: str = "x") -> DataFrame:
        return select.rows_between(self.family(family), start, stop)

    def __getitem__(self, key) -> DataFrame:
        """Entries of a slice, an id, ids or a mask, in the order of rows."""
        rows = select.key_rows(key, self.about["n_obs"])
        return self.rows(rows.start, rows.stop) if isinstance(rows, range) else self.pushed(rows, self.family())

    def annotated(self, request, **options) -> dict:
        """What a gather is annotated with, as tables: x, obs and obsm by position, obsp with both ends requested; var, varm, varp and uns whole."""
        ids = select.row_ids(request, self.about["n_obs"])
        asked = select.request_table(self.spark, ids)
        take = lambda df: asked.join(self.pushed(ids, df), "row_id").drop("row_id")
        return {
            "x": self.gather(ids, **options), "obs": take(self.obs()), "obsm": {k: take(self.part("obsm", k)) for k in self.keys("obsm")},
            "obsp": {k: select.subgraph(self.part("obsp", k), asked) for k in self.keys("obsp")}, "var": self.var(), "uns": self.uns,
        } | {kind: {k: self.part(kind, k) for k in self.keys(kind)} for kind in ("varm", "varp")}

    def range_annotated(self, start: int, stop: int) -> dict:
        """annotated() of a run of rows, without a list of them."""
        here = lambda df: df.where((F.col("row_id") >= start) & (F.col("row_id") < stop)).withColumn("row_id", F.col("row_id") - start).withColumnRenamed("row_id", "pos")
        inside = lambda c: (F.col(c) >= start) & (F.col(c) < stop)
        graph = lambda df: df.where(inside("src") & inside("dst")).select((F.col("src") - start).alias("src_pos"), (F.col("dst") - start).alias("dst_pos"), "weight")
        return {
            "x": here(self.family()), "obs": here(self.obs()), "obsm": {k: here(self.part("obsm", k)) for k in self.keys("obsm")}, "obsp": {k: graph(self.part("obsp", k)) for k in self.keys("obsp")},
            "var": self.var(), "uns": self.uns,
        } | {kind: {k: self.part(kind, k) for k in self.keys(kind)} for kind in ("varm", "varp")}

    def read_group(self, label: str) -> DataFrame:
        return self.rows(*select.group_range(self.group_spans(), label))

    def group_annotated(self, label: str) -> dict:
        return self.range_annotated(*select.group_range(self.group_spans(), label))

    def read_reference(self) -> DataFrame | None:
        """The leading rows of the reference; none without one."""
        n = self.reference_row_count()
        return None if n is None else self.rows(0, n)

    # --- shards

    def shard(self, number: int, family: str = "x") -> DataFrame:
        """Entries of one shard, rows counted from its first."""
        lo, hi = self.shard_range(number)
        return self.rows(lo, hi, family).withColumn("row_id", F.col("row_id") - lo)

    def shard_range(self, number: int) -> tuple[int, int]:
        found = self.table("shards").where(F.col("shard") == number).select("row_start", "row_stop").collect()
        if not found:
            raise KeyError(f"no shard {number}")
        return tuple(found[0])

    def shard_annotated(self, number: int) -> dict:
        return self.range_annotated(*self.shard_range(number))

    def shards_between(self, start: int, stop: int) -> DataFrame:
        return layout.shards_of_range(self.table("shards"), start, stop)

    def reference_shard(self) -> DataFrame | None:
        """Entries of the shard that holds the reference."""
        found = self.table("members").join(self.group_spans().where("role = 'reference'").select("label", "ord"), ["label", "ord"]).select("shard").distinct().collect()
        return self.shard(found[0][0]) if found else None

    def group_shards(self) -> Iterator[tuple[int, DataFrame, DataFrame]]:
        """(shard, its groups with label, lo and hi, its entries) of each shard that isn't the reference's, in order; nothing is read before it is used."""
        slices = layout.local_slices(self.table("members"), self.group_spans())
        for (number,) in slices.select("shard").distinct().orderBy("shard").collect():  # a row for each shard
            yield number, slices.where(F.col("shard") == number).select("label", "lo", "hi"), self.shard(number)

    # --- checks and changes

    def verify(self) -> bool:
        """Whether the entries are those that were written; true where no digests were kept."""
        if not self.about["checksum"]:
            return True
        return structure.verify(self.family(), self.table("digests")).first()[0]

    def update(self, name: str, df: DataFrame) -> None:
        """New annotations of the same rows (obs by row_id) or columns (var by col_id)."""
        if name not in ("obs", "var"):
            raise ValueError("obs and var can be updated")
        self.data.update(name, df, key={"obs": "row_id", "var": "col_id"}[name])
        self.about = self.data.manifest()

    def as_matrix(self) -> Matrix:
        """The archive as a source, at its stored width."""
        kinds = {kind: {k: self.part(kind, k) for k in self.keys(kind)} for kind in ("obsm", "varm", "obsp", "varp")}
        return Matrix(self.obs(), self.var(), {k: self.family(k) for k in self.matrices}, self.about["value_dtype"], uns=self.uns, **kinds)


def concat(spark: SparkSession, parts: Sequence[Archive], path: str, *, annotations: str = "preserve", overwrite: bool = False, **options) -> Archive:
    """The rows of some archives, one part after the other, as an archive of its own.

    Codec, columns, var and uns must agree; whole types are widened, fractional ones must be one. obsm and obsp have the same keys in all
    parts, varm and varp the same content; annotations="drop" leaves these four out. Layout settings that all parts share are inherited,
    others must be given. An inherited reference is each part's own leading rows, whatever their labels, if the grouping is the same.
    """
    first, abouts = parts[0], [p.about for p in parts]
    for what in ("codec", "n_vars", "uns"):
        if any(a[what] != abouts[0][what] for a in abouts):
            raise IncompatibleSchema(f"parts differ in {what}")
    if any(not store.same_rows(first.var(), p.var()) for p in parts[1:]):
        raise IncompatibleSchema("parts differ in var")
    for what in ("group_by", "sort_within_group", "sort_order", "reference"):
        if what not in options:
            if any(a[what] != abouts[0][what] for a in abouts):
                raise ValueError(f"parts differ in {what}; give one")
            options[what] = abouts[0][what]
            if what == "reference" and options["group_by"] == abouts[0]["group_by"] and abouts[0]["reference"]:
                options[what] = F.col("_ref")
            elif what == "reference":
                options[what] = abouts[0]["reference"] or None
    value = dtypes.widest([a["value_dtype"] for a in abouts])
    starts = [sum(a["n_obs"] for a in abouts[:i]) for i in range(len(parts))]
    up = lambda df, i, *cols: df.withColumns({c: (F.col(c) + F.lit(starts[i])).cast("long") for c in cols})

    def union(tables: list[DataFrame], *cols: str) -> DataFrame:
        kinds = [sorted((f.name, f.dataType.simpleString()) for f in t.schema if f.name != "value") for t in tables]
        if any(k != kinds[0] for k in kinds):
            raise IncompatibleSchema("parts differ in their columns")
        out = up(tables[0], 0, *cols)
        for i, t in enumerate(tables[1:], 1):
            out = out.unionByName(up(t, i, *cols))
        return out

    refs = [p.reference_row_count() or 0 for p in parts]
    obs = union([p.obs().drop("label", "role").withColumn("_ref", F.col("row_id") < n) for p, n in zip(parts, refs, strict=True)], "row_id")
    if any(a["families"] != abouts[0]["families"] for a in abouts):
        raise IncompatibleSchema("parts differ in their families")
    # values of all parts in the widest of their types
    wide = lambda df: df.withColumn("value", F.col("value").cast(dtypes.SPARK[value]))
    fams = {k: union([wide(p.family(k)) if k == "x" else p.family(k) for p in parts], "row_id") for k in first.matrices}
    m = Matrix(obs, first.var(), fams, value, uns=first.uns)
    if annotations == "preserve":
        for kind in ("obsm", "obsp", "varm", "varp"):
            if any(p.keys(kind) != first.keys(kind) for p in parts):
                raise IncompatibleSchema(f"parts differ in the keys of {kind}")
        for key in first.keys("obsm"):
            widths = {r[0] for p in parts for r in p.part("obsm", key).select(F.size("vec")).distinct().limit(2).collect()}
            if len(widths) > 1:
                raise IncompatibleSchema(f"parts differ in the width of {key}")
            m.obsm[key] = union([p.part("obsm", key) for p in parts], "row_id")
        for key in first.keys("obsp"):
            m.obsp[key] = union([p.part("obsp", key) for p in parts], "src", "dst")
        for kind in ("varm", "varp"):
            for key in first.keys(kind):
                if any(not store.same_rows(first.part(kind, key), p.part(kind, key)) for p in parts[1:]):
                    raise IncompatibleSchema(f"parts differ in {kind} {key}")
                getattr(m, kind)[key] = first.part(kind, key)
    elif annotations != "drop":
        raise ValueError("annotations are preserved or dropped")
    return write(spark, path, m, codec=abouts[0]["codec"], overwrite=overwrite, layout_only=["_ref"], **options)
