"""Cross-section reuse of a document's own objects, over the token relation of ``structure``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstat.functions import patterns as P
from inkstat.functions import text as T
from inkstat.operators import structure as S

TARGET = "struct<kind:string,id:string,top:bigint>"


def objects(tokens: DataFrame) -> DataFrame:
    """Body sections plus every other label inside one; subsection labels are objects of their own."""
    body = S.body_sections(tokens).select("doc_id", "top", "role", "offset")
    lab = S.labels(tokens).select("doc_id", "label", "top", "kind", "offset").join(
        S.heading_aliases(tokens), ["doc_id", "label"], "left").join(body.select("doc_id", "top", F.col("role").alias("home_role")), ["doc_id", "top"])
    tops = body.select("doc_id", F.col("top").alias("alias_top"), F.lit(True).alias("alias_in_body"))
    lab = lab.join(tops, ["doc_id", "alias_top"], "left")
    own = lab.where(~(F.coalesce(F.col("alias_in_body"), F.lit(False)) & (F.coalesce("alias_level", F.lit(0)) == 1)))
    kind = F.when(F.col("alias_level").isNotNull(), "subsection").when(F.col("kind") == "section", "other").otherwise(F.col("kind"))
    return body.select("doc_id", F.concat(F.lit("S:"), F.col("top").cast("string")).alias("object"), F.lit("section").alias("kind"),
                       F.col("top").alias("home"), F.col("role").alias("home_role"), "offset").unionByName(
        own.select("doc_id", F.concat(F.lit("L:"), F.col("label")).alias("object"), kind.alias("kind"), F.col("top").alias("home"), "home_role", "offset"))


def label_targets(tokens: DataFrame) -> DataFrame:
    """label -> object id, for labels declared in a body section."""
    body = S.body_sections(tokens).select("doc_id", "top")
    tops = body.select("doc_id", F.col("top").alias("alias_top"), F.lit(True).alias("alias_in_body"))
    lab = S.labels(tokens).select("doc_id", "label", "top").join(body, ["doc_id", "top"], "left_semi").join(
        S.heading_aliases(tokens), ["doc_id", "label"], "left").join(tops, ["doc_id", "alias_top"], "left")
    is_alias = F.coalesce(F.col("alias_in_body"), F.lit(False)) & (F.coalesce("alias_level", F.lit(0)) == 1)
    return lab.select("doc_id", "label", F.when(is_alias, F.concat(F.lit("S:"), F.col("alias_top").cast("string"))).otherwise(F.concat(F.lit("L:"), F.col("label"))).alias("object"))


def _events(df: DataFrame, parser: str, target: Column, why: Column, k: Column) -> DataFrame:
    return df.select("doc_id", F.lit(parser).alias("parser"), "src", "offset", k.cast("int").alias("k"), target.alias("target"), why.alias("why"))


def pointers(tokens: DataFrame) -> DataFrame:
    """Pointer events: doc_id, parser, src, offset, k, target (object id, 'appendix' or null), why.

    K1 reference macros, K2 printed section numbers, K3 neighbours ("the previous section"),
    named sections and the word appendix.
    """
    body = S.body_sections(tokens)
    home = body.select("doc_id", F.col("top").alias("src"))
    none = F.lit(None).cast("string")

    # K1
    ev = S.reference_events(tokens).withColumnRenamed("src_section", "src").where(~F.col("src_in_appendix")).join(home, ["doc_id", "src"], "left_semi")
    ev = ev.join(label_targets(tokens), ["doc_id", "label"], "left")
    dst_body = body.select("doc_id", F.col("top").alias("dst_section"), F.lit(True).alias("dst_in_body"))
    ev = ev.join(dst_body, ["doc_id", "dst_section"], "left")
    undefined = F.col("dst_kind") == "undefined"
    away = F.col("dst_in_appendix") | (F.col("dst_section").isNotNull() & F.col("dst_in_body").isNull())
    k1 = _events(
        ev, "K1", F.when(undefined, none).when(away, "appendix").otherwise(F.col("object")),
        F.when(undefined, "label never declared").when(~away & F.col("object").isNull(), "label declared outside the body"), F.col("k"))

    prose = S.outline(tokens).where((F.col("float_after") == 0) & ~F.col("in_appendix")).withColumnRenamed("top", "src").join(home, ["doc_id", "src"], "left_semi")

    # K2
    nums = S.section_numbers(tokens).join(body.select("doc_id", "top", F.lit(True).alias("in_body")), ["doc_id", "top"], "left")
    k2 = prose.select("doc_id", "src", "offset", F.posexplode("numbers").alias("k", "printed")).withColumn("number", F.substring_index("printed", ".", 1))
    k2 = k2.join(nums.select("doc_id", "number", "top", "in_body"), ["doc_id", "number"], "left")
    k2 = _events(k2, "K2", F.when(F.col("top").isNull(), none).when(F.col("in_body").isNull(), "appendix").otherwise(F.concat(F.lit("S:"), F.col("top").cast("string"))),
                 F.when(F.col("top").isNull(), "printed number not found"), F.col("k"))

    # K3 neighbours
    order = Window.partitionBy("doc_id").orderBy("offset")
    near = body.select("doc_id", F.col("top").alias("src"), F.lag("top").over(order).alias("prev"), F.lead("top").over(order).alias("next"))
    k3 = prose.select("doc_id", "src", "offset", F.posexplode("deictic").alias("k", "word")).join(near, ["doc_id", "src"])
    to = F.when(F.lower("word").isin("previous", "preceding", "prior", "last"), F.col("prev")).otherwise(F.col("next"))
    k3 = _events(k3, "K3", F.concat(F.lit("S:"), to.cast("string")), F.when(to.isNull(), "no adjacent section"), F.col("k"))

    # K3 named: a role held by one section, else all name tokens inside exactly one title
    named = prose.select("doc_id", "src", "offset", F.posexplode("named").alias("k", "name")).withColumn("name", F.lower(F.trim("name")))
    role = F.lit(None).cast("string")
    for word, r in S.ROLE_WORDS.items():
        role = F.when(F.col("name") == word, r).otherwise(role)
    unique_role = body.groupBy("doc_id", "role").agg(F.count(F.lit(1)).alias("c"), F.min("top").alias("role_top")).where("c = 1").drop("c")
    named = named.withColumn("role", role).join(unique_role, ["doc_id", "role"], "left")

    def words(text: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(T.tokens(text), F.lower), lambda w: ~w.isin(P.STOP_WORDS) & (F.length(w) > 2)))

    title_words = body.select("doc_id", F.col("top").alias("hit"), F.explode(words(F.col("title"))).alias("w"))
    key = ["doc_id", "src", "offset", "k"]
    hits = (
        named.select(*key, words(F.col("name")).alias("ws")).withColumn("need", F.size("ws")).select(*key, "need", F.explode("ws").alias("w"))
        .join(title_words, ["doc_id", "w"]).groupBy(*key, "need", "hit").agg(F.count(F.lit(1)).alias("got")).where(F.col("got") == F.col("need"))
        .groupBy(*key).agg(F.count(F.lit(1)).alias("c"), F.min("hit").alias("title_top")).where("c = 1").drop("c")
    )
    named = named.join(hits, key, "left").withColumn("to", F.coalesce("role_top", "title_top"))
    k3n = _events(named, "K3", F.concat(F.lit("S:"), F.col("to").cast("string")), F.when(F.col("to").isNull(), "section name not matched"), F.col("k") + 100)

    words_app = prose.where(F.col("appendix_words") > 0).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("appendix_words"))))
    k3a = _events(words_app, "K3", F.lit("appendix"), none, F.col("k") + 200)
    return k1.unionByName(k2).unionByName(k3).unionByName(k3n).unionByName(k3a)


def mark_roadmap(events: DataFrame, body: DataFrame) -> DataFrame:
    """Flag the longest run of pointers from the first body section to strictly later sections.

    Runs break where the target does not increase; the first longest run of at least two wins.
    """
    first = body.groupBy("doc_id").agg(F.min("top").alias("intro"))
    t = F.when(F.col("target").startswith("S:"), F.substring("target", 3, 10).cast("int"))
    e = events.join(first, "doc_id").withColumn("_t", t).withColumn("_c", F.coalesce((F.col("src") == F.col("intro")) & (F.col("_t") > F.col("intro")), F.lit(False)))
    w = Window.partitionBy("doc_id", "_c").orderBy("offset", "parser", "k")
    run = F.sum(F.when(F.col("_t") <= F.lag("_t").over(w), 1).otherwise(0)).over(w)
    e = e.withColumn("_broke", F.when(F.col("_t") <= F.lag("_t").over(w), 1).otherwise(0)).withColumn("_run", F.sum("_broke").over(w))
    e = e.withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "_c", "_run")))
    e = e.withColumn("_best", F.max(F.struct("_len", (-F.col("_run")).alias("r"))).over(Window.partitionBy("doc_id", "_c")))
    hit = F.col("_c") & (F.col("_len") >= 2) & (F.col("_best._len") == F.col("_len")) & (F.col("_best.r") == -F.col("_run"))
    return e.withColumn("roadmap", hit).drop("intro", "_t", "_c", "_broke", "_run", "_len", "_best")


def reach(objs: DataFrame, events: DataFrame) -> DataFrame:
    """Per object: local pointers and distinct other sections reaching it, with and without roadmap."""
    e = events.where(F.col("target").isNotNull() & (F.col("target") != "appendix")).groupBy("doc_id", F.col("target").alias("object"), "src").agg(
        F.count(F.lit(1)).alias("c"), F.count_if(~F.col("roadmap")).alias("plain"))
    j = objs.join(e, ["doc_id", "object"], "left")
    other = F.col("src") != F.col("home")
    return j.groupBy("doc_id", "object", "kind", "home", "home_role").agg(
        F.coalesce(F.sum(F.when(F.col("src") == F.col("home"), F.col("c"))), F.lit(0)).alias("n_local"),
        F.count_if(other & (F.col("plain") > 0)).alias("reach"), F.count_if(other).alias("reach_incl_roadmap"),
        F.count_if(other & (F.col("plain") > 0) & (F.col("src") > F.col("home"))).alias("backward"),
        F.count_if(other & (F.col("plain") > 0) & (F.col("src") < F.col("home"))).alias("forward"),
    ).withColumn("reused", F.col("reach") > 0)


def document_scores(reached: DataFrame, events: DataFrame) -> DataFrame:
    """1 - reused objects / objects with coverage of the pointer parsers."""
    obj = reached.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_objects"), F.count_if("reused").alias("n_reused"), F.count_if((F.col("n_local") > 0) | (F.col("reach_incl_roadmap") > 0)).alias("n_referenced"),
        F.avg("reach").alias("mean_reach"), F.max("reach").alias("max_reach"), F.count_if(F.col("reach_incl_roadmap") > 0).alias("_road"),
        F.sum("backward").alias("backward_links"), F.sum("forward").alias("forward_links"))
    ev = events.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("target").isNotNull()).alias("n_resolved"), F.count_if(F.col("target") == "appendix").alias("appendix_pointers"),
        F.count_if("roadmap").alias("n_roadmap"))
    j = obj.join(ev, "doc_id", "left").na.fill(0, ["n_events", "n_resolved", "appendix_pointers", "n_roadmap"])
    return j.select(
        "doc_id", "n_objects", "n_reused", "n_referenced", "mean_reach", "max_reach", "backward_links", "forward_links", "n_events", "n_resolved", "appendix_pointers", "n_roadmap",
        ((F.col("n_objects") - F.col("n_reused")) / F.col("n_objects")).alias("score"), (F.col("n_objects") < 3).alias("weak"),
        (F.col("_road") / F.col("n_objects")).alias("reuse_rate_incl_roadmap"),
        F.when(F.col("n_events") > 0, F.col("n_resolved") / F.col("n_events")).alias("coverage"))


def reuse_rates(reached: DataFrame, by: str) -> DataFrame:
    """Reuse rate by object kind or home role over the corpus."""
    return reached.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if("reused").alias("n_reused"), F.avg(F.col("reused").cast("int")).alias("reuse_rate"))


def unresolved_reasons(events: DataFrame) -> DataFrame:
    return events.where(F.col("why").isNotNull()).groupBy("parser", "why").agg(F.count(F.lit(1)).alias("n"))
