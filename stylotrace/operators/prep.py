"""Corpus preparation: checks, filters, cleaning, unions, generation requests."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stylotrace.fixed_values import (
    CAPITAL_LETTER,
    CYRILLIC_LETTER,
    DATELINE_PATTERNS,
    GENERATOR_LENGTHS,
    GENERATOR_MODELS,
    GENERATOR_STYLES,
    SEED,
)
from stylotrace.functions import text as T
from stylotrace.functions.numbers import ratio
from stylotrace.operators.ordering import hash_key, hash_rank
from stylotrace.session import materialise


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"corpus lacks columns: {', '.join(missing)}")
    return df


def unknown_features(groups: dict[str, Sequence[str]], known: Sequence[str]) -> dict[str, list[str]]:
    """Names in the groups that are not features, per group; groups without any are left out."""
    found = {g: [f for f in fs if f not in known] for g, fs in groups.items()}
    return {g: fs for g, fs in found.items() if fs}


def contract_report(df: DataFrame, required: Sequence[str], domains: dict[str, Sequence] | None = None) -> DataFrame:
    """One row per required column: rows, nulls, values outside the column's domain. One pass."""
    require_columns(df, required)
    domains = domains or {}
    measures = [F.count(F.lit(1)).alias("_rows")]
    for c in required:
        measures.append(F.count_if(F.col(c).isNull()).alias(f"_null_{c}"))
        outside = ~F.col(c).isin(list(domains[c])) if c in domains else F.lit(False)
        measures.append(F.count_if(outside).alias(f"_out_{c}"))
    one = df.agg(*measures)
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col("_rows").alias("n_rows"),
                F.col(f"_null_{c}").alias("n_null"),
                F.col(f"_out_{c}").alias("n_outside"),
            )
            for c in required
        ]
    )
    return one.select(F.inline(entries))


def drop_null(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(subset))


def min_length(df: DataFrame, n: int = 100, text: str = "text") -> DataFrame:
    return df.where(F.char_length(text) >= n)


FEW_DIGESTS = 1 << 19  # rows of digests that may be broadcast: under 100 MB
HOT = 1 << 16  # rows of one digest from which on it is dealt over SALTS places
SALTS = 64


def text_digest(text: str) -> Column:
    return F.sha2(F.col(text), 256)


def _salted(rows: DataFrame, digests: DataFrame, id_col: str) -> DataFrame:
    """Shuffled join of rows (_digest, id) and few facts per digest (_digest, _n, ...); hot digests are dealt out."""
    places = F.when(F.col("_n") > HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    hot = digests.where(F.col("_n") > HOT).select("_digest", F.lit(True).alias("_hot"))  # at most rows / HOT
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).otherwise(-1)
    dealt = rows.join(F.broadcast(hot), "_digest", "left").withColumn("_salt", salt).drop("_hot")
    return dealt.join(digests.withColumn("_salt", F.explode(places)), ["_digest", "_salt"])


def dedupe_exact(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """Keep the row with the lowest id of every text; of rows that repeat id and text, and of nulls, one.

    Only digests and ids are grouped, by hash aggregates that shrink copies before they move. Digests that stand in
    several rows are joined back: broadcast, if they are counted to be few, so that texts stay where they are; else the ids
    to drop are found among the narrow rows, with hot digests dealt over many tasks, and the texts move once by id.
    """
    keyed = df.withColumn("_digest", text_digest(text))
    per = keyed.groupBy("_digest", id_col).agg(F.count(F.lit(1)).alias("_n"))
    groups = per.groupBy("_digest").agg(
        F.min(id_col).alias("_first"), F.coalesce(F.min_by("_n", id_col), F.sum("_n")).alias("_same"), F.sum("_n").alias("_n")
    )
    several = materialise(groups.where((F.col("_n") > 1) & F.col("_digest").isNotNull()))
    sizes = several.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_same") > 1).alias("repeats")).first()
    stays = F.col(id_col).eqNullSafe(F.col("_first"))
    if sizes["n"] <= FEW_DIGESTS:
        kept = keyed.join(F.broadcast(several), "_digest", "left").where(F.col("_n").isNull() | stays).drop("_first", "_same", "_n")
    else:
        narrow = keyed.where("_digest is not null").select("_digest", id_col)
        losers = _salted(narrow, several, id_col).where(~stays)
        losers = losers.select(F.col("_digest").alias("_lost"), F.col(id_col).alias("_loser"))
        same = (F.col("_digest") == F.col("_lost")) & F.col(id_col).eqNullSafe(F.col("_loser"))
        kept = keyed.join(losers.hint("shuffle_hash"), same, "left_anti")
    out = kept.where("_digest is not null")
    if sizes["repeats"]:  # rows that repeat an id and a text: the only ones that are grouped as a whole
        again = several.where("_same > 1").select("_digest")
        again = F.broadcast(again) if sizes["repeats"] <= FEW_DIGESTS else again
        whole = out.join(again, "_digest", "left_semi").groupBy("_digest").agg(F.first(F.struct(*df.columns)).alias("_row"))
        out = out.join(again, "_digest", "left_anti").select(*df.columns).unionByName(whole.select("_row.*"))
    nothing = keyed.where("_digest is null").orderBy(F.col(id_col).asc_nulls_last()).limit(1)  # null texts are one text
    return out.select(*df.columns).unionByName(nothing.select(*df.columns))


def binarise_label(label: Column, human: str = "human") -> Column:
    return F.when(label.isNull(), F.lit(None)).when(label == human, 0).otherwise(1).cast("int")


def clean_text(text: Column, patterns: Sequence[str] = DATELINE_PATTERNS, capital: str = CAPITAL_LETTER) -> Column:
    """Blanks for line breaks, datelines cut in sequence, head cut to the first capital, trimmed."""
    out = F.translate(text, "\n\r\xa0", "   ")
    for p in patterns:
        out = F.regexp_replace(out, F.lit("(?iuU)" + p), F.lit(""))
    from_capital = F.regexp_extract(out, f"(?s){capital}.*", 0)
    out = F.when(from_capital != "", from_capital).otherwise(out)
    return F.coalesce(T.strip(out), F.lit(""))


def with_clean_text(df: DataFrame, text: str = "text", **kwargs) -> DataFrame:
    return df.withColumn(text, clean_text(F.col(text), **kwargs))


def length_columns(df: DataFrame, text: str = "text") -> DataFrame:
    filled = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns(
        {
            "length_words": F.size(T.whitespace_words(filled)).cast("int"),
            "length_chars": F.char_length(filled).cast("int"),
        }
    )


def default_topic(topic: Column) -> Column:
    name = T.strip(topic)
    return F.when(name.isNull() | name.isin("", "nan"), "General").otherwise(name)


def fill_defaults(df: DataFrame, topic: str = "topic") -> DataFrame:
    """Blank topics become General; temperature and top_p are only filled when the column is absent."""
    out = df.withColumn(topic, default_topic(F.col(topic)))
    for name, value in (("temperature", 0.7), ("top_p", 0.9)):
        if name not in df.columns:
            out = out.withColumn(name, F.lit(value))
    return out


CORPUS_COLUMNS = ["text", "is_ai", "is_redacted", "source", "topic", "temperature", "top_p"]


def harmonise_human(df: DataFrame, rubric: str = "rubric") -> DataFrame:
    return df.select(
        "text",
        F.lit(False).alias("is_ai"),
        F.lit(False).alias("is_redacted"),
        F.lit("human_archive").alias("source"),
        F.coalesce(F.col(rubric), F.lit("General")).alias("topic"),
        F.lit(0.0).alias("temperature"),
        F.lit(0.0).alias("top_p"),
        *[c for c in ("doc_id",) if c in df.columns],
    )


def harmonise_generated(df: DataFrame) -> DataFrame:
    filled = df.withColumn("topic", F.coalesce(F.col("topic"), F.lit("General")))
    for name, value in (("temperature", 0.7), ("top_p", 0.9)):
        if name not in df.columns:
            filled = filled.withColumn(name, F.lit(value))
    return filled.select(
        "text",
        F.lit(True).alias("is_ai"),
        F.col("redacted").cast("boolean").alias("is_redacted"),
        "source",
        "topic",
        F.col("temperature").cast("double").alias("temperature"),
        F.col("top_p").cast("double").alias("top_p"),
        *[c for c in ("doc_id",) if c in df.columns],
    )


def harmonise_and_union(human: DataFrame, generated: DataFrame) -> DataFrame:
    return harmonise_human(human).unionByName(harmonise_generated(generated))


def build_corpus(human: DataFrame, generated: DataFrame, per_class: int | None = None, seed: int = SEED) -> DataFrame:
    """The labelled corpus from both pools: dedupe and clean, sample, stack, shuffle, measure.

    Both pools need a ``doc_id`` that is unique across them. Without ``per_class`` all rows stay.
    """
    from stylotrace.operators.sampling import sample_per_class, shuffle_with_ids

    people = with_clean_text(dedupe_exact(drop_null(human, ["text"]), "doc_id"))
    machines = with_clean_text(generated)
    stacked = materialise(harmonise_and_union(people, machines))  # cleaned once; ranking reads its input twice
    sampled = stacked if per_class is None else sample_per_class(stacked, "doc_id", "is_ai", per_class, seed)
    shuffled = shuffle_with_ids(sampled, "doc_id", seed).drop("doc_id")
    return length_columns(shuffled)


def corpus_profile(df: DataFrame, id_redacted: str = "is_redacted") -> DataFrame:
    """Rows, share, redacted rows and mean words per class and source label, with class totals.

    One pass over the corpus; shares come from the grouped result.
    """
    from pyspark.sql import Window

    grouped = df.groupBy("is_ai", "source").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(id_redacted)).alias("n_redacted"),
        F.sum("length_words").alias("n_words"),
    )
    # One row per (class, source label): small next to the corpus.
    per_class = Window.partitionBy("is_ai")
    overall = Window.partitionBy(F.lit(1))
    return grouped.select(
        "is_ai",
        "source",
        "n_rows",
        "n_redacted",
        F.floor(F.col("n_words") / F.col("n_rows")).cast("bigint").alias("mean_words"),
        F.sum("n_rows").over(per_class).alias("class_rows"),
        F.round(F.sum("n_rows").over(per_class) / F.sum("n_rows").over(overall), 6).alias("class_share"),
    )


def corpus_totals(df: DataFrame, id_redacted: str = "is_redacted") -> DataFrame:
    """One row for the whole corpus: rows, rows of each class, redacted rows, mean words (rounded down; 0 without rows)."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("is_ai").alias("n_ai"),
        F.count_if(~F.col("is_ai")).alias("n_human"),
        F.count_if(id_redacted).alias("n_redacted"),
        F.coalesce(F.floor(F.sum("length_words") / F.count("length_words")), F.lit(0)).cast("bigint").alias("mean_words"),
    )


def script_share(text: Column, letter: str = CYRILLIC_LETTER) -> Column:
    """Percent of whitespace words with at least one letter of the script; 0 for no words."""
    words = T.whitespace_words(text)
    hits = F.size(F.filter(words, lambda w: w.rlike(letter)))
    return ratio(hits, F.size(words)) * 100.0


def quality_gate(
    df: DataFrame, text: str = "text", min_words: int = 100, letter: str = CYRILLIC_LETTER, min_share: float = 50.0
) -> DataFrame:
    """Add ``accepted`` and ``reason`` (ok, short, script); too short wins over wrong script."""
    source = F.coalesce(F.col(text), F.lit(""))
    words = F.size(T.whitespace_words(source))
    reason = (
        F.when(words < min_words, "short").when(script_share(source, letter) < min_share, "script").otherwise("ok")
    )
    return df.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "ok")


def strip_echoed_title(text: Column, title: Column) -> Column:
    """Drop the first line when the text begins with its title, bare or in guillemets; trim."""
    stripped = T.strip(text)
    echoed = stripped.startswith(title) | stripped.startswith(F.concat(F.lit("«"), title, F.lit("»")))
    first_break = F.instr(stripped, "\n")
    body = F.when(first_break > 0, F.substring(stripped, first_break + 1, F.char_length(stripped))).otherwise(stripped)
    return F.when(echoed, T.strip(body)).otherwise(stripped)


def hash_uniform(key: Column, salt: str) -> Column:
    """Repeatable number in [0, 1) from a key: 32 bits of md5."""
    bits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(":" + salt))), 1, 8)
    return F.conv(bits, 16, 10).cast("double") / F.lit(float(1 << 32))


def _choice(u: Column, options: Sequence) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.floor(u * len(options)) + 1).cast("int"))


def generation_plan(
    titles: DataFrame, n: int | None = None, id_col: str = "doc_id", seed: int = SEED, start: int = 0
) -> DataFrame:
    """Requests for a text generator: model by turns, sampling settings, length, style, drawn title.

    ``titles`` has ``doc_id``, ``title`` and ``topic``. One request per title unless ``n`` is given.
    Titles are drawn with replacement: each request hashes to a position in a dense numbering.
    """
    spark = titles.sparkSession
    numbered = (
        hash_rank(titles.select(id_col, "title", "topic"), id_col, [], seed)
        .withColumn("pick", F.col("_rank") - 1)
        .select("pick", "title", "topic")
    )
    total = titles.count()
    key = F.concat(F.lit(f"{seed}:"), F.col("request_id"))
    kind = F.pmod(F.col("request_id") - 1, F.lit(len(GENERATOR_MODELS)))
    requests = spark.range(start + 1, start + 1 + (total if n is None else n)).select(F.col("id").alias("request_id"))

    def by_model(field: int, otherwise: Column) -> Column:
        out = otherwise
        for i, model in enumerate(GENERATOR_MODELS):
            if model[field] is not None:
                out = F.when(kind == i, F.lit(model[field])).otherwise(out)
        return out

    planned = requests.select(
        "request_id",
        by_model(0, F.lit(None).cast("string")).alias("model_id"),
        by_model(1, F.lit(None).cast("string")).alias("model_label"),
        by_model(2, F.round(hash_uniform(key, "t") * 0.6 + 0.3, 2)).alias("temperature"),
        by_model(3, F.round(hash_uniform(key, "p") * 0.2 + 0.8, 2)).alias("top_p"),
        _choice(hash_uniform(key, "l"), GENERATOR_LENGTHS).alias("target_length"),
        _choice(hash_uniform(key, "s"), GENERATOR_STYLES).alias("style"),
        F.floor(hash_uniform(key, "d") * total).cast("bigint").alias("pick"),
    )
    return planned.join(numbered, "pick").withColumn("topic", default_topic(F.col("topic"))).drop("pick")


def resume_target(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows written to ``path`` so far; none, with the schema, if there is no such target yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def resume_from(existing: DataFrame, id_col: str = "id") -> DataFrame:
    """One row with the highest id written so far; 0 for an empty target."""
    return existing.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint").alias("last_id"))


def resume_new_rows(existing: DataFrame, incoming: DataFrame, id_col: str, seed: int = SEED) -> DataFrame:
    """Incoming rows not written yet, numbered on from the highest id written."""
    fresh = incoming.join(existing.select(id_col), id_col, "left_anti")
    last = resume_from(existing, id_col).first()["last_id"]
    return hash_rank(fresh, id_col, [], seed).withColumn("new_id", F.col("_rank") + F.lit(last)).drop("_rank", "_total")


def split_disjoint(train: DataFrame, test: DataFrame, text: str = "text") -> DataFrame:
    """Test rows whose text is in no train row; null texts are in none.

    Both sides are reduced to their distinct digests first; what they share is broadcast if it is counted to be few, so
    test texts are neither shuffled nor sorted. Beyond that they move once, with hot digests dealt over many tasks.
    """
    seen = train.select(text_digest(text).alias("_digest")).distinct()
    counted = test.groupBy(text_digest(text).alias("_digest")).agg(F.count(F.lit(1)).alias("_n"))
    shared = materialise(counted.join(seen, "_digest", "left_semi"))
    keyed = test.withColumn("_digest", text_digest(text))
    if shared.count() <= FEW_DIGESTS:
        return keyed.join(F.broadcast(shared), "_digest", "left_anti").drop("_digest")
    places = F.when(F.col("_n") > HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    hot = F.broadcast(shared.where(F.col("_n") > HOT).select("_digest", F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.floor(F.rand(SEED) * SALTS).cast("int")).otherwise(0)
    dealt = keyed.join(hot, "_digest", "left").withColumn("_salt", salt)
    spread_out = shared.withColumn("_salt", F.explode(places)).hint("shuffle_hash")
    return dealt.join(spread_out, ["_digest", "_salt"], "left_anti").drop("_digest", "_salt", "_hot")
