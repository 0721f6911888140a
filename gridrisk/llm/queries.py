"""The registered queries of this subpackage: each applies one operator to its whole table and returns what its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, ctw, decontam, licenses, near_dups, packing, pii, quality, runs, token_files, toxicity, url_lists, whitening
from .common import crc_mod, table
from .oracles import ORACLE_SQL  # noqa: F401


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.spans(docs, pii.train(docs)).drop("text")
    base = F.filter("pii_spans", lambda s: s["base"])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("pii_spans")).alias("spans"))


def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of all pages, fetched on a day that their URL gives, against entries for two thirds of hosts, domains and paths."""
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 7), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n).cast("timestamp")
    captures = table(spark, sf_dir, "pages").select("page_id", "url", day(number(F.col("url")) % 360).alias("fetched_at"))
    listed = captures.select(F.explode(url_lists.patterns(F.col("url"))).alias("pattern")).distinct().withColumn("k", number(F.col("pattern")))
    entries = listed.where(F.col("k") % 3 > 0).select("pattern", F.explode(F.array(
        F.struct(F.when(F.col("k") % 2 == 0, "block").otherwise("allow").alias("action"), day(F.col("k") % 120).alias("listed_at")),
        F.struct(F.when(F.col("k") % 5 < 3, "remove").otherwise("block").alias("action"), day(120 + F.col("k") % 110).alias("listed_at")),
        F.struct(F.lit("allow").alias("action"), day(230 + F.col("k") % 200).alias("listed_at")),
    )).alias("e")).select("pattern", "e.action", "e.listed_at")
    return url_lists.judge(captures, entries).select("page_id", "url", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"), "verdict", "matched_pattern", F.date_format("listed_at", "yyyy-MM-dd").alias("listed_on"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), crc_mod("doc_id", 3) == 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write(table(spark, sf_dir, "documents"))
    return token_files.read(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scores(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) != 1)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    f = chat.format_conversations(c.unionByName(more))
    f = f.withColumn("turns", chat.read_turns("formatted")).withColumn("loss", chat.read_loss("formatted", "loss_mask"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return f.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.match(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.col("item_ids")
    return hits.select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.groups(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = whitening.integers(table(spark, sf_dir, "embeddings"))
    w = whitening.fit(x)
    explained = F.array(*[F.lit(float(e / w.trace)) for e in w.values]).cast("array<double>")
    rows = whitening.transform(x, w).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return rows.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, "k").alias("explained"), F.lit(whitening.identity_error(x, w)).alias("identity_error")
    )


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("base", lambda b: b["n"] > 0)
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("base", F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.transform(base, lambda b: b["label"])), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        F.round("score", 6).alias("score"),
        F.size("licenses").cast("long").alias("n_spans"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in all documents, of which a tenth repeat some of their own words from a word on that their doc_id gives."""
    d, h = table(spark, sf_dir, "documents").select("doc_id", "text"), F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    again = F.expr("transform(sequence(0, size(words) - 1), i -> if(i < a, words[i], words[cast(a + (i - a) % p as int)]))")
    changed = d.where(h % 10 == 0).select("doc_id", "text", words.alias("words"), F.floor(h / 10).alias("g")).withColumn("a", F.expr("if(size(words) > 0, g % size(words), 0)"))
    changed = changed.withColumn("p", F.expr("1 + (size(words) - a) div (3 + g % 8)")).select("doc_id", F.when(F.size("words") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
    found = runs.collapse(d.where(F.coalesce(h % 10 != 0, F.lit(True))).unionByName(changed))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("longest", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_personal_data": op1_personal_data,
    "op2_url_lists": op2_url_lists,
    "op3_toxicity": op3_toxicity,
    "op4_token_files": op4_token_files,
    "op5_context_tree": op5_context_tree,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontamination": op8_decontamination,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_packing": op10_packing,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_license_scans": op12_license_scans,
    "op13_periodic_runs": op13_periodic_runs,
}
