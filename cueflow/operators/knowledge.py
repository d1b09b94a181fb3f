"""Knowledge base of learned corrections: upsert, relevance, best correction, rule order."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cueflow import constants as K
from cueflow.functions.ordered import number_in_order
from cueflow.functions.skew import deal, join_spread
from cueflow.session import settle

KEY = ["wrong_term", "correct_term", "topic", "industry", "country"]

# Weights (in tenths) of a context match when picking the best correction.
_MATCH_TENTHS = {"country": 100, "topic": 50, "industry": 50}
_COUNT_CAP = 10
# Weights (in halves) of the relevance score.
_RELEVANCE_HALVES = {"country": 4, "topic": 2, "industry": 2, "general": 1}


def upsert(kb: DataFrame, batch: DataFrame) -> DataFrame:
    """New KB version after a batch of occurrences (key columns, tags, seq = arrival order).

    Occurrences are counted per key before they meet the KB, so a key repeated millions of times
    shuffles as one row per map task. Known rows keep their id, tags and confidence. New rows get
    the next ids in arrival order.
    """
    fresh = batch.fillna("general", ["topic", "industry", "country"]).groupBy(*KEY).agg(
        F.count("*").alias("new_count"),
        F.min_by("tags", "seq").alias("new_tags"),
        F.min("seq").alias("first_seq"),
    )
    # Read twice below; a batch may come from costly work such as a diff.
    fresh = settle(fresh, "fresh-entries")
    next_id = kb.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next")).scalar()
    known = kb.join(fresh.select(*KEY, "new_count"), KEY, "left").select(
        "id", *KEY, "tags", "confidence",
        (F.col("count") + F.coalesce("new_count", F.lit(0))).alias("count"),
    )
    unknown = fresh.join(kb.select(*KEY), KEY, "left_anti")
    added = number_in_order(unknown, ["first_seq"], "id", next_id).select(
        F.col("id").cast("long").alias("id"), *KEY, F.col("new_tags").alias("tags"),
        F.lit(1.0).alias("confidence"), F.col("new_count").alias("count"),
    )
    return known.unionByName(added)


def remove_entries(kb: DataFrame, ids: DataFrame) -> DataFrame:
    return kb.join(ids.select("id").distinct(), "id", "left_anti")


SCOPES = ["country", "topic", "industry"]


def _matches(columns: list[Column]) -> Column:
    """array<struct<mask, country, topic, industry>>: every choice of scopes that has no null."""
    choices = []
    for mask in range(1, 1 << len(SCOPES)):
        chosen = [F.lower(c) if mask >> n & 1 else F.lit("") for n, c in enumerate(columns)]
        whole = F.lit(True)
        for c in chosen:
            whole = whole & c.isNotNull()
        key = F.struct(F.lit(mask).alias("mask"), *(
            c.alias(f"key_{name}") for name, c in zip(SCOPES, chosen, strict=True)))
        choices.append(F.when(whole, key))
    return F.filter(F.array(*choices), lambda k: k.isNotNull())


_MATCH_KEY = ["mask", *(f"key_{name}" for name in SCOPES)]


def relevance_classes(kb: DataFrame, contexts: DataFrame) -> DataFrame:
    """Entries relevant to each context, counted by how they match: at most 15 rows a context.

    (topic, industry, country, mask, is_general, score, entries). Bit n of `mask` says that the entry
    has the context's value of SCOPES[n]. The KB is counted once for every choice of scopes; a context
    looks up its seven choices, and the exact classes follow by inclusion and exclusion, so no
    context meets an entry. `contexts` are distinct combinations.
    """
    general = F.coalesce(F.col("country") == "general", F.lit(False)).alias("is_general")
    choices = kb.select(general, F.inline(_matches([F.col(n) for n in SCOPES])))
    counts = settle(
        choices.groupBy(*_MATCH_KEY, "is_general").agg(F.count("*").alias("n")), "relevance-counts")
    total = kb.select(general).agg(F.count_if("is_general").alias("n")).scalar()
    wanted = settle(contexts.select("topic", "industry", "country").distinct(), "relevance-contexts")
    asked = wanted.select("*", F.inline(_matches([F.col(n) for n in SCOPES])))
    met = asked.join(counts, _MATCH_KEY)
    at_least = [F.coalesce(F.sum(F.when(F.col("mask") == m, F.col("n"))), F.lit(0)).alias(f"n{m}")
                for m in range(1, 8)]
    found = met.groupBy("topic", "industry", "country", "is_general").agg(*at_least)
    # a context that meets nothing still has the general entries
    every = wanted.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("is_general"))
    same = [every[c].eqNullSafe(found[c]) for c in ("topic", "industry", "country", "is_general")]
    sized = every.join(found, same, "left").select(
        *(every[c] for c in every.columns),
        F.when(every["is_general"], total).otherwise(F.lit(0)).alias("n0"),
        *(F.coalesce(f"n{m}", F.lit(0)).alias(f"n{m}") for m in range(1, 8)))

    def exact(mask: int) -> Column:
        out = F.lit(0)
        for other in range(8):
            if other & mask == mask:
                sign = -1 if (other ^ mask).bit_count() % 2 else 1
                out = out + sign * F.col(f"n{other}")
        return out

    halves = [sum(_RELEVANCE_HALVES[n] for i, n in enumerate(SCOPES) if mask >> i & 1) for mask in range(8)]
    classes = F.array(*(F.struct(
        F.lit(mask).alias("mask"),
        ((F.lit(halves[mask]) + F.when(F.col("is_general"), _RELEVANCE_HALVES["general"]).otherwise(0))
         / F.lit(2.0)).alias("score"), exact(mask).alias("entries")) for mask in range(8)))
    return sized.select("topic", "industry", "country", "is_general", F.inline(classes)).where(
        (F.col("entries") > 0) & (F.col("score") > 0)).select(
        "topic", "industry", "country", "mask", "is_general", "score",
        F.col("entries").cast("long").alias("entries"))


def class_members(kb: DataFrame, classes: DataFrame) -> DataFrame:
    """(context columns, KB id, score) of the entries of `classes` (some of `relevance_classes`)."""
    entries = kb.select(
        "id", *(F.lower(F.col(n)).alias(f"own_{n}") for n in SCOPES),
        F.coalesce(F.col("country") == "general", F.lit(False)).alias("general"))
    own = [F.col(f"own_{n}") for n in SCOPES]
    keyed = entries.select("*", F.inline(_matches(own)))
    asked = classes.select("*", F.inline(F.filter(
        _matches([F.col(n) for n in SCOPES]), lambda k: k["mask"] == F.col("mask"))).alias(
            "met_mask", *_MATCH_KEY[1:])).drop("met_mask")
    exact = F.col("general") == F.col("is_general")
    for n, name in enumerate(SCOPES):
        differs = F.coalesce(F.col(f"own_{name}") != F.lower(F.col(name)), F.lit(True))
        exact = exact & ((F.col("mask").bitwiseAND(1 << n) > 0) | differs)
    columns = ["topic", "industry", "country", "id", "score"]
    met = asked.join(keyed, _MATCH_KEY).where(exact).select(*columns)
    # of no scope of the context, general only: one list for all such classes
    rest = classes.where(F.col("mask") == 0).join(
        entries.where("general").withColumn("mask", F.lit(0)), "mask").where(exact).select(*columns)
    return met.unionByName(rest)


def relevant_entries(kb: DataFrame, contexts: DataFrame) -> DataFrame:
    """(context columns, KB id, score) of every entry relevant to a context: all pairs.

    Use `relevance_classes` for scores and counts, and `class_members` for the classes wanted.
    """
    return class_members(kb, settle(relevance_classes(kb, contexts), "relevance-classes"))


def top_entries(kb: DataFrame, contexts: DataFrame, limit: int = K.TOP_ENTRIES) -> DataFrame:
    """First `limit` relevant entries per context by (wrong_term, id), with their rank from 1.

    The first `limit` of a union are among the first `limit` of its members, so each scope of the
    KB is cut to `limit` rows first and no context meets more than four such lists.
    """
    scope_rows = []
    for name in ["country", "topic", "industry"]:
        scope_rows.append(
            F.struct(F.lit(name).alias("scope"), F.lower(F.col(name)).alias("scope_value"))
        )
    general = F.struct(F.lit("general").alias("scope"), F.lit("").alias("scope_value"))
    entries = kb.select(
        "id", "wrong_term", "correct_term",
        F.inline(F.filter(
            F.array(*scope_rows, F.when(F.col("country") == "general", general)),
            lambda s: s.isNotNull(),
        )),
    )
    order = ["wrong_term", "id"]
    per_scope = Window.partitionBy("scope", "scope_value").orderBy(*order)
    heads = entries.withColumn("n", F.row_number().over(per_scope)).where(F.col("n") <= limit)
    wanted = contexts.select("topic", "industry", "country").distinct().select(
        "topic", "industry", "country", F.inline(F.array(*scope_rows, general))
    )
    met = wanted.join(heads.drop("n"), ["scope", "scope_value"]).select(
        "topic", "industry", "country", "id", "wrong_term", "correct_term"
    ).distinct()
    per_context = Window.partitionBy("topic", "industry", "country").orderBy(*order)
    return met.withColumn("rank", F.row_number().over(per_context)).where(F.col("rank") <= limit)


def entry_lines(ranked: DataFrame) -> DataFrame:
    """`- wrong -> right` lines per context, in rank order."""
    line = F.concat(F.lit("- "), F.col("wrong_term"), F.lit(" -> "), F.col("correct_term"))
    rows = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return ranked.groupBy("topic", "industry", "country").agg(
        F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("kb_lines")
    )


def _match_sets() -> list[tuple[str, ...]]:
    names = list(_MATCH_TENTHS)
    return [c for size in range(len(names) + 1) for c in combinations(names, size)]


def _scoped(name: str, members: tuple[str, ...]) -> Column:
    return F.when(F.lit(name in members), F.lower(F.col(name))).otherwise(F.lit("")).alias(name)


def best_corrections(kb: DataFrame, lookups: DataFrame) -> DataFrame:
    """Best correction for each (term, topic, industry, country): the highest score wins.

    The score adds 10, 5 and 5 for a country, topic and industry match (never for "general") and
    a tenth per count up to ten. For each of the eight sets of matched columns the KB is first cut
    to its best row per term and values, so a lookup meets at most eight rows however many entries
    share its term. Ties go to the smallest (correct_term, topic, industry, country).
    """
    sets = _match_sets()
    tie = ["correct_term", "topic", "industry", "country"]
    known = kb.select(
        "wrong_term",
        F.least(F.col("count"), F.lit(_COUNT_CAP)).alias("points"),
        F.struct(*tie).alias("row"),
        F.explode(F.array(*[
            F.when(
                F.lit(True)
                if not members
                else ~F.array_contains(
                    F.array(*[F.lower(F.col(m)) for m in members]), "general"
                ),
                F.struct(
                    F.lit(number).alias("match_set"),
                    *[_scoped(n, members).alias(f"m_{n}") for n in _MATCH_TENTHS],
                ),
            )
            for number, members in enumerate(sets)
        ])).alias("scope"),
    ).where(F.col("scope").isNotNull())
    scope_columns = ["match_set", *[f"m_{n}" for n in _MATCH_TENTHS]]
    best_known = known.groupBy(
        "wrong_term", *[F.col(f"scope.{c}").alias(c) for c in scope_columns]
    ).agg(
        F.min(F.struct((-F.col("points")).alias("minus_points"), "row")).alias("best")
    )
    asked = lookups.select("term", "topic", "industry", "country").distinct()
    wanted = asked.select(
        "term", "topic", "industry", "country",
        F.inline(F.array(*[
            F.struct(
                F.lit(number).alias("match_set"),
                F.lit(sum(_MATCH_TENTHS[m] for m in members)).alias("match_tenths"),
                *[_scoped(n, members).alias(f"m_{n}") for n in _MATCH_TENTHS],
            )
            for number, members in enumerate(sets)
        ])),
    ).withColumnRenamed("term", "wrong_term")
    scored = wanted.join(best_known, ["wrong_term", *scope_columns]).select(
        F.col("wrong_term").alias("term"), "topic", "industry", "country",
        F.struct(
            (F.col("best.minus_points") - F.col("match_tenths")).alias("minus_score"),
            F.col("best.row").alias("row"),
        ).alias("candidate"),
    )
    return scored.groupBy("term", "topic", "industry", "country").agg(
        F.min("candidate").alias("winner")
    ).select(
        "term", "topic", "industry", "country",
        F.col("winner.row.correct_term").alias("correct_term"),
        (-F.col("winner.minus_score")).cast("long").alias("score_tenths"),
    )


def best_for_documents(kb: DataFrame, lookups: DataFrame) -> DataFrame:
    """`best_corrections` attached to lookups (doc_id, term, context); null where none is known."""
    context = ["term", "topic", "industry", "country"]
    best = best_corrections(kb, lookups)
    return join_spread(lookups, best, context, "left", by=["doc_id"])


def builtin_rules(spark: SparkSession) -> DataFrame:
    rows = [(w, r, n) for n, (w, r) in enumerate(K.BUILTIN_SPELLINGS)]
    return spark.createDataFrame(rows, "wrong string, right string, n long")


def corpus_rules(kb: DataFrame) -> DataFrame:
    """Spelling rules that hold for every document: (wrong, right, stage, n).

    A term's place is its first mention (built-in list before KB, KB by id), its replacement the
    last one written.
    """
    builtin = builtin_rules(kb.sparkSession).select(
        "wrong", "right", F.lit(0).alias("stage"), "n"
    )
    learned = kb.select(
        F.col("wrong_term").alias("wrong"), F.col("correct_term").alias("right"),
        F.lit(2).alias("stage"), F.col("id").alias("n"),
    )
    place = F.struct("stage", "n")
    return builtin.unionByName(learned).groupBy("wrong").agg(
        F.min(place).alias("first"), F.max_by("right", place).alias("right")
    ).select("wrong", "right", "first.stage", "first.n")


def misspellings(manifests: DataFrame) -> DataFrame:
    """(doc_id, wrong, right, n) of manifest entities, without what looks like an abbreviation.

    A misspelling that is shorter than the name and part of it is skipped, unless the style guide
    says `Strict`.
    """
    entities = manifests.select(
        "doc_id", F.col("manifest.style_guide").alias("style_guide"),
        F.posexplode("manifest.entities").alias("entity_no", "entity"),
    )
    listed = entities.select(
        "doc_id", "style_guide", "entity_no", F.col("entity.name").alias("right"),
        F.posexplode("entity.common_misspellings").alias("spelling_no", "wrong"),
    )
    abbreviation = (
        (F.length("wrong") < F.length("right"))
        & F.contains(F.col("right"), F.col("wrong"))
        & ~F.contains(F.col("style_guide"), F.lit("Strict"))
    )
    return listed.where(~abbreviation).select(
        "doc_id", "wrong", "right",
        (F.col("entity_no") * F.lit(1 << 32) + F.col("spelling_no")).alias("n"),
    )


def document_rules(manifests: DataFrame, kb: DataFrame) -> DataFrame:
    """Rules a document's manifest adds or changes: (doc_id, wrong, right, stage, n).

    With `corpus_rules`, minus the terms listed here, this is the document's whole ordered map;
    the corpus-wide part is never copied per document.
    """
    # dealt out first: aggregates over strings sort, which one large file would do in one task
    own = misspellings(deal(manifests, "doc_id")).groupBy("doc_id", "wrong").agg(
        F.min("n").alias("n"), F.max_by("right", "n").alias("own_right")
    )
    kb_terms = kb.groupBy(F.col("wrong_term").alias("wrong")).agg(
        F.max_by("correct_term", "id").alias("kb_right")
    )
    # one row per term of the corpus, some of which nearly all documents have
    corpus = settle(corpus_rules(kb).join(kb_terms, "wrong", "left").select(
        "wrong", "kb_right", F.col("stage").alias("corpus_stage"), F.col("n").alias("corpus_n")), "terms")
    placed = join_spread(own, corpus, ["wrong"], "left", by=["doc_id"])
    builtin = F.col("corpus_stage") == 0
    return placed.select(
        "doc_id", "wrong", F.coalesce("kb_right", "own_right").alias("right"),
        F.when(builtin, F.lit(0)).otherwise(F.lit(1)).alias("stage"),
        F.when(builtin, F.col("corpus_n")).otherwise(F.col("n")).alias("n"),
    )
