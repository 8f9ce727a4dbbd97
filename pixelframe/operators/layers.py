"""Output layers: classification, routing, naming, matching to input images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.functions.arrays import power_of_two
from pixelframe.functions.names import stem

# Words in a file name that tell the kind of layer it holds.
MASK_WORD = "mask"
NOT_MASK_WORD = "labeled"
LABEL_WORDS = ["label", "objects", "segmented"]


def layer_kind(filename: Column, pixels: Column, dtype: Column) -> Column:
    """``mask`` / ``label`` / ``intensity``: the file name decides first, then the values."""
    name = F.lower(F.coalesce(filename, F.lit("")))
    values = F.array_distinct(pixels)
    few = (F.size(values) <= 3) & F.forall(values, lambda v: v.isin(0.0, 1.0, 255.0))
    many = dtype.rlike("^u?int") & (F.size(values) > 2) & (F.array_max(pixels) > 1)
    return (
        F.when(name.contains(MASK_WORD) & ~name.contains(NOT_MASK_WORD), "mask")
        .when(name.rlike("|".join(LABEL_WORDS)), "label")
        .when(few, "mask")
        .when(many, "label")
        .otherwise("intensity")
    )


def classify_layer(planes: DataFrame, filename: str = "filename") -> DataFrame:
    return planes.withColumn("kind", layer_kind(F.col(filename), F.col("pixels"), F.col("dtype")))


def organize_layers(planes: DataFrame, filename: str = "filename") -> dict[str, DataFrame]:
    """Route planes to masks, labels and intensity by kind."""
    routed = classify_layer(planes, filename)
    return {
        folder: routed.filter(F.col("kind") == kind)
        for folder, kind in (("masks", "mask"), ("labels", "label"), ("intensity", "intensity"))
    }


def layer_name(source: Column, frame_index: Column, kind: str) -> Column:
    """``<stem>_fNNN_<kind>.tif``; frames without a source file are called ``frame_NNN``."""
    index = frame_index.cast("int")
    base = F.coalesce(stem(source), F.format_string("frame_%03d", index))
    return F.format_string(f"%s_f%03d_{kind}.tif", base, index)


def _substrings(text: Column, length: Column) -> Column:
    """Distinct substrings of one length; none if the text is shorter."""
    last = F.length(text) - length + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: text.substr(i, length)))


def _gram_length(text: Column) -> Column:
    """The largest power of two that is not above the length, 0 for an empty text: at least half of the text."""
    n = F.length(text)
    return F.when(n == 0, F.lit(0)).otherwise(power_of_two(F.length(F.bin(n)) - 1))


def _first_containing(stems: DataFrame, layers: DataFrame) -> DataFrame:
    """``(_stem, _inside)``: smallest ``_order`` among the layers whose stem contains ``_stem``.

    A stem is sought by the rarest of its grams, whose length is a power of two of at least half the stem, and what is
    found by it is verified. Layers are indexed by grams of the lengths that some stem uses, so a name gives no more
    rows than its length for each of at most a handful of powers. Only grams that some stem has are counted.
    """
    # a scalar: powers of two up to the longest name
    lengths = stems.agg(F.collect_set(_gram_length(F.col("_stem")))).scalar()
    grams = F.flatten(F.transform("_lengths", lambda q: _substrings(F.col("_layer"), q)))
    indexed = layers.withColumn("_lengths", lengths).select("_layer", "_order", F.explode(grams).alias("_gram"))
    own = _substrings(F.col("_stem"), _gram_length(F.col("_stem")))
    sought = stems.select("_stem", F.explode(own).alias("_gram"))
    counted = (
        indexed.join(sought.select("_gram").distinct(), "_gram", "left_semi")
        .groupBy("_gram")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    rarity = F.struct(F.coalesce("_n", F.lit(0).cast("bigint")).alias("n"), F.col("_gram").alias("gram"))
    rarest = sought.join(counted, "_gram", "left").groupBy("_stem").agg(F.min(rarity).alias("_rarest"))
    keys = rarest.filter(F.col("_rarest.n") > 0).select("_stem", F.col("_rarest.gram").alias("_gram"))
    found = indexed.join(keys, "_gram").filter(F.col("_layer").contains(F.col("_stem")))
    return found.groupBy("_stem").agg(F.min("_order").alias("_inside"))


def match_outputs(images: DataFrame, layers: DataFrame) -> DataFrame:
    """``(image_name, layer_path)``: the layer belonging to each image stem.

    An equal stem wins; otherwise the first layer (``.tif`` before ``.tiff``, then path) whose
    stem contains the image stem, found by the stem's rarest gram, so no image meets every
    layer. Layers of one stem are one row before anything is compared; the winners are
    partially aggregated minima. Null names match nothing.
    """
    wanted = images.select("image_name", stem(F.col("image_name")).alias("_stem"))
    order = F.struct(
        F.lower(F.col("layer_path")).endswith(".tiff").alias("late"), F.col("layer_path").alias("path")
    )
    available = (
        layers.select(stem(F.col("layer_path")).alias("_layer"), order.alias("_order"))
        .groupBy("_layer")
        .agg(F.min("_order").alias("_order"))
    )
    keys = wanted.select("_stem").distinct()
    exact = available.withColumnsRenamed({"_layer": "_stem", "_order": "_exact"}).join(keys, "_stem", "left_semi")
    open_keys = keys.join(exact, "_stem", "left_anti").filter(F.col("_stem").isNotNull())
    return (
        wanted.join(exact, "_stem", "left")
        .join(_first_containing(open_keys, available), "_stem", "left")
        .select("image_name", F.coalesce("_exact.path", "_inside.path").alias("layer_path"))
    )


def attach_layers(images: DataFrame, masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Images with their mask and label layer; images with neither are left out."""
    mask = match_outputs(images, masks).withColumnRenamed("layer_path", "mask_path")
    label = match_outputs(images, labels).withColumnRenamed("layer_path", "label_path")
    return (
        images.join(mask, "image_name", "left")
        .join(label, "image_name", "left")
        .filter(F.col("mask_path").isNotNull() | F.col("label_path").isNotNull())
    )


def attach_by_name(
    images: DataFrame, layers: DataFrame, prefix: Column, name: str = "layer_name"
) -> DataFrame:
    """Images joined to ``<prefix>_mask.tif`` and ``<prefix>_labels.tif`` by exact name.

    Used for folder runs (prefix = stem) and stack runs (prefix = stem and frame tag). The
    ``skipped`` flag marks images for which neither file exists.
    """
    out = images.withColumn("_prefix", prefix)
    for kind, column in (("mask", "mask_name"), ("labels", "label_name")):
        found = layers.select(F.col(name).alias(column)).distinct()
        out = out.join(found, F.concat("_prefix", F.lit(f"_{kind}.tif")) == F.col(column), "left")
    return out.drop("_prefix").withColumn(
        "skipped", F.col("mask_name").isNull() & F.col("label_name").isNull()
    )
