"""License scans with DataFrame functions only: a positional index of the rarest licence words.

A template is a short licence text with mandatory key phrases. Of each template the
index holds the words that the fewest documents have, with their positions. A file's
words are looked up there; each hit says where the template would start (its position
less the template's), hits that agree on a start are counted, and the key phrases must
stand at their places from that start. The index and the templates are parameters of
bounded size and are broadcast; no document meets another one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ID, TEXT, materialize, ship_package
from .decontam import norm_words

#: words of a template that the index holds, and the share of them that must agree on a start
RAREST, AGREE = 4, 0.5


@dataclass(frozen=True)
class Template:
    """``text``: words in lower case; key phrases: the parts in [brackets]. ``base`` templates are single key phrases."""

    label: str
    text: str
    base: bool = False
    words: list[str] = field(init=False, default_factory=list)
    must: list[int] = field(init=False, default_factory=list)

    def __post_init__(self):
        inside = self.base
        for word in self.text.replace("[", " [ ").replace("]", " ] ").split():
            if word in "[]":
                inside = word == "["
                continue
            if inside:
                self.must.append(len(self.words))
            self.words.append(word)


# fixed values: phrases and labels of the base, in order
BASE = [Template("gpl", "gnu general public license", True), Template("apache", "apache license", True), Template("cc-by", "cc by", True), Template("mit", "mit license", True)]
# fixed values: words of public licence notices, without marks, in lower case; key phrases in brackets
NOTICES = [
    Template("gpl-3.0", "this work is licensed under the [gnu general public license version 3]"),
    Template("gpl-2.0", "this work is licensed under the [gnu general public license version 2]"),
    Template("lgpl", "licensed under the [gnu lesser general public license]"),
    Template("agpl", "licensed under the [gnu affero general public license]"),
    Template("apache-2.0", "[licensed under the apache license version 2 0]"),
    Template("cc-by-4.0", "[licensed under cc by 4 0]"),
    Template("cc-by-nc-4.0", "[licensed under cc by nc 4 0]"),
    Template("cc-by-sa-4.0", "[licensed under cc by sa 4 0]"),
    Template("mit-notice", "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files the software to deal in the [software without restriction]"),
    Template("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted provided that [the following conditions are met]"),
    Template("mpl-2.0", "[this source code form is subject to the terms of the mozilla public license v 2 0]"),
    Template("isc", "[permission to use copy modify and or distribute this software for any purpose] with or without fee is hereby granted"),
]


def _lit(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def template_table(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """template, base, words: a row for each template."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(t.base).alias("base"), _lit(t.words).alias("words")) for i, t in enumerate(templates)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def rare_word_index(words: DataFrame, templates: DataFrame, rarest: int = RAREST) -> DataFrame:
    """word, at, need, template: a posting for each place of the words that the fewest rows of ``words`` (w) have.

    A base template has one posting, the first place of its rarest word. Equally rare
    words are taken in the order of their places.
    """
    vocabulary = [r["word"] for r in templates.select(F.explode("words").alias("word")).distinct().orderBy("word").collect()]  # the parameter's words
    # the licence words of each document, once each, counted over all documents
    held = words.select(F.explode(F.array_intersect(_lit(vocabulary), F.col("w"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("docs"))
    places = templates.select("*", F.posexplode("words").alias("at", "word")).join(held, "word", "left")
    by_rarity = Window.partitionBy("template").orderBy(F.coalesce("docs", F.lit(0)), "at")
    taken = F.when(F.col("base"), F.lit(1)).otherwise(F.least(F.lit(rarest), F.size("words")))
    need = F.when(F.col("base"), F.lit(1)).otherwise(F.ceil(taken * F.lit(AGREE)).cast("int"))
    return places.withColumn("_n", F.row_number().over(by_rarity)).where(F.col("_n") <= taken).select("word", "at", need.alias("need"), "template")


def find_starts(files: DataFrame, index: DataFrame) -> DataFrame:
    """rid, starts: where templates (template, start) can stand in ``files`` (rid, w), by the agreement of their indexed words."""
    hits = files.select("rid", F.posexplode("w").alias("pos", "word")).join(F.broadcast(index), "word")
    agreed = hits.groupBy("rid", "template", (F.col("pos") - F.col("at")).alias("start")).agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
    return agreed.where(F.col("n") >= F.col("need")).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "template"))).alias("starts"))


def verified(starts: Column, w: Column, templates: list[Template]) -> Column:
    """(start, label, base, score) of the starts at which all key phrases stand in the words ``w``."""
    words, must = (F.array(*[_lit(x) for x in xs]) for xs in ([t.words for t in templates], [t.must for t in templates]))
    labels, base = _lit([t.label for t in templates]), _lit([t.base for t in templates])

    def same(c: Column):
        return lambda i: F.get(w, c["start"] + i).eqNullSafe(F.get(F.get(words, c["template"]), i))

    def place(c: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(F.get(words, c["template"])) - F.lit(1))
        score = F.size(F.filter(places, same(c))) / F.size(places)
        return F.struct(c["start"].cast("long").alias("start"), F.get(labels, c["template"]).alias("label"), F.get(base, c["template"]).alias("base"), score.alias("score"))

    return F.transform(F.filter(starts, lambda c: F.forall(F.get(must, c["template"]), same(c))), place)


def scan_licenses(docs: DataFrame, id_col: str = ID, text_col: str = TEXT, base: list[Template] = BASE, notices: list[Template] = NOTICES, rarest: int = RAREST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    The n_base places of base phrases start at first_word to last_word (from 0). ``labels``
    adds the labels of the notices found; a notice needs half of its indexed words and all
    its key phrases at their places. ``score`` is the largest share of a template's words
    at their places, over all verified places (a base phrase: 1), 0 without one. ``places``
    lists (start, label, base, score).

    Edge cases: NULL text has no words. Overlapping places all count. Rows that repeat an
    id, or have none, are scanned each on their own. A document without an indexed word
    ends with the first look-up; the others' words are written once. A very long text is one
    row's work, in proportion to its length. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    words = docs.select(F.col(f"`{id_col}`").alias(ID), norm_words(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("w"))
    templates = [*base, *notices]
    index = materialize(rare_word_index(words, template_table(spark, templates), rarest), "license_index")
    rare = [r["word"] for r in index.select("word").distinct().orderBy("word").collect()]  # at most `rarest` words per template
    # every row is named once, in a written table, so its name holds for all that follows
    held = words.select(F.monotonically_increasing_id().alias("rid"), ID, F.size("w").cast("long").alias("n_words"), F.when(F.arrays_overlap("w", _lit(rare)), F.col("w")).alias("w"))
    files = materialize(held, "license_files")
    licensed = files.where(F.col("w").isNotNull()).select("rid", "w")
    places = licensed.join(find_starts(licensed, index), "rid").select("rid", verified(F.col("starts"), F.col("w"), templates).alias("places")).where(F.size("places") > 0)
    based = F.filter("places", lambda p: p["base"])
    one_each = lambda at: F.array_join(F.array_sort(F.array_distinct(F.transform(at, lambda p: p["label"]))), ",")
    found = places.select(
        "rid", F.size(based).cast("long").alias("n_base"), F.array_min(F.transform(based, lambda p: p["start"])).alias("first_word"), F.array_max(F.transform(based, lambda p: p["start"])).alias("last_word"),
        one_each(based).alias("base_labels"), one_each(F.col("places")).alias("labels"), F.array_max(F.transform("places", lambda p: p["score"])).alias("score"), "places",
    )
    out = files.select("rid", ID, "n_words").join(found, "rid", "left")
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return out.select(ID, "n_words", *[F.coalesce(c, none[c]).alias(c) if c in none else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")], "places")
