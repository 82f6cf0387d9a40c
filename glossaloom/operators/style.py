"""Voice of a translator: excerpts, scene types, stylometry and top-k retrieval."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaloom.functions import text as X
from glossaloom.lexicon import STYLE_STOPWORDS
from glossaloom.operators.modelcalls import apply_rowwise, call_model
from glossaloom.plans.lineage import cut, written
from glossaloom.plans.ordered import first_rows, ranked

SCENES = ["dialogue", "action", "description", "internal", "transition"]

# Words that carry sound, thought, action and contraction counts.
SOUNDS = (
    r"(?iU)\b(?:pak|thud|crash|bang|boom|splat|whack|smack|gasp|huff|snarl|growl|clang|screech|squelch|thwack|whoosh|ugh|argh"
    r"|grr|hmm|pfft|clack|creak)\b"
)
THOUGHT_WORDS = "thought|wondered|realized|remembered|felt|knew|pondered|considered|reflected|mused"
ACTION_VERBS = (
    r"(?U)\b(?:ran|drew|struck|leapt|ducked|charged|grabbed|kicked|punched|slammed|pulled|pushed|threw|swung|lunged|stabbed"
    r"|slashed|broke|crashed|shattered|exploded|bolted|sprang|dived|rolled|dashed|rushed|sprinted|fell|dropped|collapsed)\b"
)
CONTRACTIONS = (
    r"(?iU)\b(?:can't|won't|don't|doesn't|didn't|isn't|aren't|wasn't|weren't|hasn't|haven't|hadn't|couldn't|shouldn't|wouldn't"
    r"|mustn't|needn't|let's|that's|who's|what's|here's|there's|where's|when's|how's|I'm|you're|he's|she's|it's|we're|they're"
    r"|I've|you've|we've|they've|I'll|you'll|he'll|she'll|it'll|we'll|they'll|I'd|you'd|he'd|she'd|we'd|they'd)\b"
)


def paragraph_rows(chapters: DataFrame) -> DataFrame:
    return chapters.select("novel", "chapter", F.posexplode(X.paragraphs(F.col("text"))).alias("pos", "paragraph"))


def dialogue_spans(text: Column) -> Column:
    return F.regexp_count(text, F.lit(X.DIALOGUE))


def pick_excerpts(chapters: DataFrame, per_chapter: int = 2, max_chars: int = 350) -> DataFrame:
    """``novel, chapter, rank, excerpt``: paragraphs with most dialogue, then longest; long ones end at a word."""
    p = F.col("paragraph")
    top = first_rows(
        paragraph_rows(chapters), ["novel", "chapter"], [dialogue_spans(p).desc(), F.length(p).desc(), F.col("pos")], per_chapter, "rank"
    )
    head = F.substring(p, 1, max_chars)
    cut_head = F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, "(?s) [^ ]*$", "")).otherwise(head)
    return top.select("novel", "chapter", "rank", F.when(F.length(p) <= max_chars, p).otherwise(F.concat(cut_head, F.lit("…"))).alias("excerpt"))


def style_stats(chapters: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sentences, words per sentence and dialogue share of a corpus; counted per chapter, then summed."""
    per_chapter = chapters.select(*(by or []), X.full_sentences(F.col("text")).alias("s")).select(
        *(by or []),
        F.size("s").alias("n_sentences"),
        F.aggregate("s", F.lit(0), lambda a, x: a + F.size(X.words(x))).alias("n_words"),
        F.size(F.filter("s", lambda x: x.rlike(X.DIALOGUE))).alias("n_dialogue"),
    )
    sums = per_chapter.groupBy(*(by or [])).agg(
        F.count("*").alias("n_chapters"),
        *[F.sum(c).alias(c) for c in ("n_sentences", "n_words", "n_dialogue")],
    )
    return sums.withColumn("mean_words", F.when(F.col("n_sentences") > 0, F.col("n_words") / F.col("n_sentences"))).withColumn(
        "dialogue_percent", F.when(F.col("n_sentences") > 0, 100 * F.col("n_dialogue") / F.col("n_sentences"))
    )


def style_bank(chapters: DataFrame, per_chapter: int = 2, max_chars: int = 350, include_stats: bool = True) -> DataFrame:
    """Excerpts of every chapter, plus one line of statistics per novel (null chapter)."""
    bank = pick_excerpts(chapters, per_chapter, max_chars)
    if not include_stats:
        return bank
    line = F.format_string(
        "%d chapters: about %.0f words per sentence; about %.0f%% of sentences carry dialogue", "n_chapters", "mean_words", "dialogue_percent"
    )
    stats = style_stats(chapters, ["novel"]).where("n_sentences > 0").select(
        "novel", F.lit(None).cast("bigint").alias("chapter"), F.lit(1).alias("rank"), line.alias("excerpt")
    )
    return bank.unionByName(stats)


def style_tokens(text: Column) -> Column:
    # Leaving out stop words leaves each token once.
    return F.array_except(X.content_tokens(text, 3), X.words_lit(STYLE_STOPWORDS))


def classify_scene(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(text.rlike("[\"“]"), "dialogue")
        .when(low.rlike(THOUGHT_WORDS), "internal")
        .when(F.size(X.words(text)) < 25, "transition")
        .when(F.regexp_count(low, F.lit(ACTION_VERBS)) >= 3, "action")
        .otherwise("description")
    )


def exemplars(chapters: DataFrame, per_scene: int = 3, embed_fn: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """The richest paragraphs per chapter and scene type: ``novel, chapter, scene, rank, text[, embedding]``."""
    p = F.col("paragraph")
    n_words = F.size(X.words(p))
    richness = F.regexp_count(p, F.lit("[\"“]")) / F.greatest(n_words, F.lit(1)) * 10 + F.least(n_words / 50, F.lit(1.0))
    rows = paragraph_rows(chapters).withColumn("scene", classify_scene(p)).withColumn("richness", richness)
    top = first_rows(rows, ["novel", "chapter", "scene"], [F.col("richness").desc(), F.col("pos")], per_scene, "rank")
    if embed_fn is not None:
        top = apply_rowwise(top, ["paragraph"], "embedding array<float>", embed_fn)
    extra = ["embedding"] if embed_fn is not None else []
    return top.select("novel", "chapter", "scene", "rank", F.substring(p, 1, 500).alias("text"), *extra)


# --------------------------------------------------------------------------- exact top-k against a bank

BANK_BLOCK = 5_000
#: Rows of a block of bank and queries whose tokens are numbers, and of a block of vectors, as multiples of ``block``.
POSTING_BLOCKS, ASKED_BLOCKS, VECTOR_BLOCKS = 20, 2, 8


def top_k(
    queries: DataFrame,
    bank: DataFrame,
    k: int,
    method: str = "jaccard",
    by: list[str] | None = None,
    block: int = BANK_BLOCK,
    bonus: str | None = None,
    earlier: tuple[str, str] | None = None,
) -> DataFrame:
    """The ``k`` bank items most similar to each query, exactly: ``by, query_id, item_id, score, rank``.

    ``queries`` has ``by, query_id, features``, ``bank`` the same with ``item_id``; features are distinct
    tokens (``jaccard``) or vectors (``cosine``), ``bonus`` names a bank column added to the score.  Ties go
    to the smaller ``item_id``.  ``earlier`` names a bank number that must be below a query number (bank column,
    query column).  Tokens of banks of at most ``block`` rows a group meet in blocks of about ``block`` rows of both sides,
    vectors in blocks ``VECTOR_BLOCKS`` times as large, each pair of which is a task that keeps k rows a query; tokens of larger
    banks are numbered first, see ``_by_postings``.  No pair list exists and nothing passes through the driver.
    """
    by = by or []
    number = F.col(earlier[0]) if earlier else F.lit(0)
    below = F.col(earlier[1]) if earlier else F.lit(float("inf"))
    extra = F.col(bonus) if bonus else F.lit(0.0)
    bank = written(bank.select(*by, "item_id", "features", extra.cast("double").alias("bonus"), number.cast("double").alias("number")).where("features is not null"))
    asked = written(queries.select(*by, "query_id", "features", below.cast("double").alias("below")).where("features is not null"))
    n_bank = _n_blocks(bank, by, block)
    if method == "cosine":
        n_bank, n_asked = _n_blocks(bank, by, block * VECTOR_BLOCKS), _n_blocks(asked, by, block * VECTOR_BLOCKS)
        n_asked = _enough(bank, n_bank, n_asked)
        scored = _by_blocks(asked, bank, by, _vector_scorer(by, k), n_bank, n_asked)
    elif n_bank > 1:
        scored = _by_postings(asked, bank, k, by, block)
    else:
        scored = _by_blocks(asked, bank, by, _cell_scorer(by, k), n_bank, _n_blocks(asked, by, block))
    return first_rows(scored, [*by, "query_id"], [F.col("score").desc(), F.col("item_id")], k, "rank")


def _by_postings(asked: DataFrame, bank: DataFrame, k: int, by: list[str], block: int) -> DataFrame:
    """``by, query_id, item_id, score`` of the k best by shared tokens in each block of the bank.

    Tokens become numbers of the bank's vocabulary by a join; a query keeps those that some item holds.  So rows are short, blocks
    of the bank are ``POSTING_BLOCKS`` times as large, and a query is sent to each of those blocks, not to each item it meets.
    """
    words = bank.select(F.explode("features").alias("t")).distinct().withColumn("_all", F.lit(0))
    vocabulary = cut(ranked(words, "_all", [F.col("t")], "code").select("t", F.col("code").cast("int").alias("code")))

    def coded(df: DataFrame, key: str, *more: str) -> DataFrame:
        tokens = df.select(*by, key, F.explode("features").alias("t")).join(vocabulary, "t").groupBy(*by, key).agg(F.collect_list("code").alias("codes"))
        rows = df.select(*by, key, *more, F.size("features").alias("size")).join(tokens, [*by, key], "left")
        return written(rows.withColumn("codes", F.coalesce("codes", F.array().cast("array<int>"))))

    items, queries = coded(bank, "item_id", "bonus", "number"), coded(asked, "query_id", "below")
    n_bank, n_asked = _n_blocks(items, by, block * POSTING_BLOCKS), _n_blocks(queries, by, block * ASKED_BLOCKS)
    return _by_blocks(queries, items, by, _posting_scorer(by, k), n_bank, _enough(bank, n_bank, n_asked))


def _enough(df: DataFrame, n_bank: int, n_asked: int) -> int:
    """So many blocks of queries that a bank of few blocks still keeps all cores busy."""
    return max(n_asked, -(-2 * df.sparkSession.sparkContext.defaultParallelism // n_bank))


def _n_blocks(df: DataFrame, by: list[str], block: int) -> int:
    return max(1, -(-(df.groupBy(*by).count().agg(F.max("count")).head()[0] or 0) // block))


def _posting_scorer(by: list[str], k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Scores queries against the items of one block that hold one of their tokens; of the others the best bonus counts."""

    def score(asked: pd.DataFrame, bank: pd.DataFrame) -> pd.DataFrame:
        columns = [*by, "query_id", "item_id", "score"]
        if bank.empty or asked.empty:
            return pd.DataFrame(columns=columns)
        bank = bank.sort_values("number", kind="stable")
        ids, bonus, numbers, held = (bank[c].to_numpy() for c in ("item_id", "bonus", "number", "size"))
        n = len(bank)
        by_id = np.empty(n, np.int64)
        by_id[np.argsort(ids, kind="stable")] = np.arange(n)
        by_bonus = np.lexsort((by_id, -bonus))
        codes = np.concatenate([np.asarray(c, np.int32) for c in bank["codes"]])
        order = np.argsort(codes, kind="stable")
        holders = np.repeat(np.arange(n, dtype=np.int32), [len(c) for c in bank["codes"]])[order]
        known, starts, lengths = np.unique(codes[order], return_index=True, return_counts=True)

        rows, items, values = [], [], []
        for row, (own, asking, below) in enumerate(zip(asked["codes"], asked["size"].to_numpy(), asked["below"].to_numpy())):
            # Items lie by number, so those below the query's come first.
            open_items = int(np.searchsorted(numbers, below)) if below == below else 0
            if not open_items:
                continue
            place = np.searchsorted(known, own := np.asarray(own, np.int32))
            place = place[known[np.minimum(place, len(known) - 1)] == own] if len(known) else place[:0]
            each = lengths[place]
            within = np.arange(each.sum()) + np.repeat(starts[place] - (np.cumsum(each) - each), each)
            shared = np.bincount(holders[within], minlength=n)[:open_items]
            hits = np.flatnonzero(shared)
            value = shared[hits] / (asking + held[hits] - shared[hits]) + bonus[hits]
            if len(hits) > k:
                best = value >= np.partition(value, len(hits) - k)[len(hits) - k]
                hits, value = hits[best], value[best]
            rest, step = hits[:0], 64 * k
            while len(rest) < k and step < 2 * n + 64 * k:
                rest = by_bonus[:step]
                rest = rest[rest < open_items]
                rest, step = rest[shared[rest] == 0][:k], step * 8
            hits, value = np.concatenate([hits, rest]), np.concatenate([value, bonus[rest]])
            best = np.lexsort((by_id[hits], -value))[:k]
            rows.append(np.full(len(best), row))
            items.append(hits[best])
            values.append(value[best])
        if not rows:
            return pd.DataFrame(columns=columns)
        found = asked.iloc[np.concatenate(rows)][[*by, "query_id"]]
        return found.assign(item_id=ids[np.concatenate(items)], score=np.concatenate(values))[columns]

    return score


def _by_blocks(asked: DataFrame, bank: DataFrame, by: list[str], scorer: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], n_bank: int, n_asked: int) -> DataFrame:
    """``by, query_id, item_id, score``: both sides dealt by hash into blocks; k rows a query and pair of blocks."""
    deal = lambda df, key, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n))).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    )
    cell = [*by, "_bank", "_asked"]
    left = deal(asked, "query_id", "_asked", n_asked, "_bank", n_bank).withColumn("_bank", F.col("_bank").cast("bigint"))
    right = deal(bank, "item_id", "_bank", n_bank, "_asked", n_asked).withColumn("_asked", F.col("_asked").cast("bigint"))
    schema = T.StructType(
        [asked.schema[c] for c in by]
        + [asked.schema["query_id"], T.StructField("item_id", bank.schema["item_id"].dataType), T.StructField("score", T.DoubleType())]
    )
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(scorer, schema)


#: Pairs of query and item that are scored at once, and postings that are gone through at once.
SCORED_AT_ONCE, POSTINGS_AT_ONCE = 1 << 20, 1 << 22


#: Pairs that are scored in full at once.
COMPARED_AT_ONCE = 1 << 16


def _vector_scorer(by: list[str], k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Scores query vectors against the items of one block by their cosines.

    One single-precision product of unit vectors finds the items that may be among the k best; only these are scored in double
    precision, each pair by itself and in the order of its places, so no score depends on what else is in the block.
    """

    def squares(vectors: np.ndarray) -> np.ndarray:
        return np.cumsum(vectors * vectors, axis=1)[:, -1]

    def units(vectors: np.ndarray, square: np.ndarray) -> np.ndarray:
        scale = np.sqrt(square)[:, None]
        return np.divide(vectors, scale, out=np.zeros_like(vectors), where=scale > 0).astype(np.float32)

    def score(asked: pd.DataFrame, bank: pd.DataFrame) -> pd.DataFrame:
        columns, found = [*by, "query_id", "item_id", "score"], []
        if bank.empty or asked.empty:
            return pd.DataFrame(columns=columns)
        # items lie in id order, so of equal scores the first counts
        bank = bank.sort_values("item_id", kind="stable")
        ids, bonus, numbers = bank["item_id"].to_numpy(), bank["bonus"].to_numpy(), bank["number"].to_numpy()
        items = np.array(bank["features"].to_list(), np.float64)
        square = squares(items)
        near, sound = np.ascontiguousarray(units(items, square).T), np.isfinite(square)
        # Four times what single precision may be off by.
        slack = 4 * (items.shape[1] + 8) * np.finfo(np.float32).eps * (1 + np.abs(bonus).max())
        step = max(1, SCORED_AT_ONCE // len(bank))
        for at in range(0, len(asked), step):
            rows = asked.iloc[at : at + step]
            vectors = np.array(rows["features"].to_list(), np.float64)
            own, below = squares(vectors), rows["below"].to_numpy()
            about = units(vectors, own) @ near
            if bonus.any():
                about += bonus.astype(np.float32)
            about[~np.isfinite(own)] = -np.inf
            if not sound.all():
                about[:, ~sound] = -np.inf
            if not (numbers.max() < below).all():
                about[~(numbers < below[:, None])] = -np.inf
            least = _kth(about, k)
            row, item = np.nonzero((about >= (least - np.float32(slack))[:, None]) & (about > -np.inf))
            values = np.empty(len(row))
            for part in range(0, len(row), COMPARED_AT_ONCE):
                r, i = row[part : part + COMPARED_AT_ONCE], item[part : part + COMPARED_AT_ONCE]
                dots, scale = np.cumsum(vectors[r] * items[i], axis=1)[:, -1], np.sqrt(own[r] * square[i])
                values[part : part + COMPARED_AT_ONCE] = np.clip(np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0), -1, 1) + bonus[i]
            order = np.lexsort((item, -values, row))
            row, item, values = row[order], item[order], values[order]
            begin = np.searchsorted(row, np.arange(len(rows)))
            best = np.arange(len(row)) - begin[row] < k
            found.append(rows.iloc[row[best]][[*by, "query_id"]].assign(item_id=ids[item[best]], score=values[best]))
        return pd.concat(found)[columns]

    return score


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest value of each row, its least one if there are fewer."""
    k, every = min(k, values.shape[1]), np.arange(len(values))
    if k > 8:
        return np.partition(values, -k, axis=1)[:, -k]
    taken = []
    for _ in range(k):
        place = values.argmax(axis=1)
        taken.append((place, values[every, place]))
        values[every, place] = -np.inf
    for place, value in reversed(taken):
        values[every, place] = value
    return taken[-1][1]


def _jaccards(items: pd.Series) -> Callable[[pd.Series], np.ndarray]:
    """The Jaccard similarities of queries with all items, from postings of the items' tokens."""
    n, sizes = len(items), items.map(len).to_numpy(np.int64)
    codes, known = pd.factorize(np.concatenate([np.asarray(t, object) for t in items]))
    holders = np.repeat(np.arange(n), sizes)[np.argsort(codes, kind="stable")]
    lengths = np.bincount(codes, minlength=len(known))
    starts, index = np.cumsum(lengths) - lengths, pd.Index(known)

    def score(queries: pd.Series) -> np.ndarray:
        asking = queries.map(len).to_numpy(np.int64)
        places = index.get_indexer(np.concatenate([np.asarray(t, object) for t in queries])) if asking.sum() else np.zeros(0, np.int64)
        rows, places = np.repeat(np.arange(len(asking)), asking)[places >= 0], places[places >= 0]
        shared = np.zeros(len(asking) * n)
        parts = np.cumsum(lengths[places]) // POSTINGS_AT_ONCE
        for part in np.unique(parts):
            own = slice(*np.searchsorted(parts, [part, part + 1]))
            each = lengths[places[own]]
            within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            met = holders[np.repeat(starts[places[own]], each) + within]
            shared += np.bincount(np.repeat(rows[own], each) * n + met, minlength=len(shared))
        shared = shared.reshape(len(asking), n)
        union = asking[:, None] + sizes - shared
        return np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)

    return score


def _cell_scorer(by: list[str], k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Scores the queries of one block against the items of one block by their tokens."""

    def score(asked: pd.DataFrame, bank: pd.DataFrame) -> pd.DataFrame:
        columns, found = [*by, "query_id", "item_id", "score"], []
        bank = bank.sort_values("item_id", kind="stable")
        if bank.empty or asked.empty:
            return pd.DataFrame(columns=columns)
        ids, bonus, numbers = bank["item_id"].to_numpy(), bank["bonus"].to_numpy(), bank["number"].to_numpy()
        similar = _jaccards(bank["features"])
        step = max(1, SCORED_AT_ONCE // len(bank))
        for at in range(0, len(asked), step):
            rows = asked.iloc[at : at + step]
            closed = numbers >= rows["below"].to_numpy()[:, None]
            values = np.where(closed, -np.inf, similar(rows["features"]) + bonus)
            # items lie in id order, so a stable sort keeps ties in it
            best = np.argsort(-values, axis=1, kind="stable")[:, :k]
            row, place = np.nonzero(np.take_along_axis(values, best, axis=1) > -np.inf)
            item = best[row, place]
            found.append(rows.iloc[row][[*by, "query_id"]].assign(item_id=ids[item], score=values[row, item]))
        return pd.concat(found)[columns]

    return score


def retrieve_excerpts(chapters: DataFrame, bank: DataFrame, k: int = 8, by: list[str] | None = None) -> DataFrame:
    """Excerpts closest to each chapter by shared words, vivid ones first by 0.15.

    ``chapters`` has ``by, query_id, text``; ``bank`` has ``by, item_id, excerpt``.
    """
    by = by or []
    queries = chapters.select(*by, "query_id", style_tokens(F.col("text")).alias("features"))
    items = bank.select(
        *by, "item_id", style_tokens(F.col("excerpt")).alias("features"), F.when(F.col("excerpt").rlike(SOUNDS), 0.15).otherwise(0.0).alias("bonus")
    )
    return top_k(queries, items, k, "jaccard", by, bonus="bonus")


def prior_excerpts(chapters: DataFrame, originals: DataFrame, snippets: DataFrame, k: int = 4) -> DataFrame:
    """Voice lines for MTL chapters: curated snippets and one excerpt of each original with a lower number.

    ``chapters``/``originals`` have ``novel, chapter, text``; ``snippets`` has ``novel, pos, text``.  A line that
    occurs twice counts at its first place.  Returns ``novel, chapter, rank, excerpt, score``.
    """
    derived = pick_excerpts(originals, 1, 300).select("novel", F.col("chapter").alias("number"), F.col("rank").alias("pos"), "excerpt")
    curated = snippets.select("novel", F.lit(-1).cast("bigint").alias("number"), F.col("pos").cast("int").alias("pos"), F.col("text").alias("excerpt"))
    lines = curated.unionByName(derived).groupBy("novel", "excerpt").agg(F.min(F.struct("number", "pos")).alias("at"))
    bank = lines.select(
        "novel", "at.number", "excerpt", F.format_string("%020d %06d", F.col("at.number") + 1, "at.pos").alias("item_id"),
        style_tokens(F.col("excerpt")).alias("features"), F.when(F.col("excerpt").rlike(SOUNDS), 0.15).otherwise(0.0).alias("bonus"),
    )
    bank = cut(bank)
    queries = chapters.select("novel", F.col("chapter").alias("query_id"), style_tokens(F.col("text")).alias("features"))
    top = top_k(queries, bank, k, "jaccard", ["novel"], bonus="bonus", earlier=("number", "query_id"))
    return top.join(bank.select("novel", "item_id", "excerpt"), ["novel", "item_id"]).select(
        "novel", F.col("query_id").alias("chapter"), "rank", "excerpt", "score"
    )


def retrieve_exemplars(
    queries: DataFrame, bank: DataFrame, k: int = 3, scene: str | None = None, scenes: list[str] | None = None
) -> DataFrame:
    """Exemplars closest to each query: by vectors when both sides have ``embedding``, else by shared words.

    ``scene`` keeps one scene type; ``scenes`` takes ``k`` of each listed type (balanced retrieval).
    """
    vectors = "embedding" in queries.columns and "embedding" in bank.columns
    feature = F.col("embedding") if vectors else F.array_distinct(X.content_tokens(F.col("text"), 3))
    items = bank.where(F.col("scene") == scene) if scene else bank
    if vectors:
        items = items.where("embedding is not null")
    asked = queries.select("query_id", feature.alias("features"))
    method = "cosine" if vectors else "jaccard"
    if scenes is None:
        return top_k(asked, items.select("item_id", feature.alias("features")), k, method)
    spread = asked.select(F.explode(X.words_lit(scenes)).alias("scene"), "query_id", "features")
    return top_k(spread, items.select("scene", "item_id", feature.alias("features")), k, method, by=["scene"])


# --------------------------------------------------------------------------- stylometry


def stylometry(df: DataFrame, text: str = "text", prefix: str = "", splitter: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add the style metrics of ``text``, all computed inside the row; null for a text without sentences.

    ``splitter`` gives the sentence array (default: punctuation followed by white space).
    """
    s, t = f"_{prefix}s", f"_{prefix}h"
    split = splitter or X.full_sentences
    df = df.withColumn(s, split(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn(t, X.histogram(F.flatten(F.transform(s, lambda x: X.content_tokens(x, 3)))))
    lengths = F.transform(s, lambda x: F.size(X.words(x)).cast("double"))
    n = F.size(s)
    mean = X.let(lengths, lambda ls: F.aggregate(ls, F.lit(0.0), lambda a, v: a + v) / F.size(ls))
    variance = X.let(
        lengths,
        lambda ls: X.let(
            F.aggregate(ls, F.lit(0.0), lambda a, v: a + v) / F.size(ls),
            lambda m: F.aggregate(ls, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.size(ls),
        ),
    )
    n_tokens = F.aggregate(t, F.lit(0), lambda a, h: a + h["n"].cast("int"))
    share = lambda part: F.when(n_tokens > 0, part / n_tokens).otherwise(0.0)
    metrics = {
        "avg_sentence_length": (mean, 2),
        "sentence_length_variance": (variance, 2),
        "lexical_richness": (share(F.size(t)), 4),
        "hapax_ratio": (share(F.size(F.filter(t, lambda h: h["n"] == 1))), 4),
        "contraction_rate": (F.size(F.filter(s, lambda x: x.rlike(CONTRACTIONS))) / n, 4),
        "dialog_share": (F.size(F.filter(s, lambda x: x.rlike(X.DIALOGUE))) / n, 4),
    }
    kept = [c for c in df.columns if c not in (s, t)]
    return df.select(*kept, *[F.when(n > 0, X.rounded(c.cast("double"), d)).alias(prefix + m) for m, (c, d) in metrics.items()])


METRICS = [
    "avg_sentence_length", "sentence_length_variance", "lexical_richness", "hapax_ratio", "contraction_rate", "dialog_share",
]


def stylometry_delta(a: str, b: str, metric: str) -> Column:
    """Absolute difference of one metric of two prefixes, a missing one counting 0."""
    zero = F.lit(0.0)
    return X.rounded(F.abs(F.coalesce(F.col(a + metric), zero) - F.coalesce(F.col(b + metric), zero)), 4)


def voice_richness(prefix: str = "", digits: int = 4) -> Column:
    spread = F.least(F.col(prefix + "sentence_length_variance"), F.lit(500.0)) / 500.0
    score = 0.4 * F.col(prefix + "lexical_richness") + 0.3 * F.col(prefix + "dialog_share") + 0.3 * spread
    return F.coalesce(X.rounded(score, digits), F.lit(0.0))


# --------------------------------------------------------------------------- model-written profiles


def _head(text: Column, limit: int | None) -> Column:
    return text if limit is None else F.substring(text, 1, limit)


def profile_prompt(text: Column, limit: int | None = 2000) -> Column:
    """Asks for the style of a text; ``limit``: characters of it that the model sees, None for all."""
    return F.concat(
        F.lit(
            "Describe the style of this translated fiction in three labelled lines.\nREGISTER: point of view, formality, tone\n"
            "NARRATION: sentence rhythm, vocabulary, imagery\nDIALOGUE: register shifts, punctuation, formality\n\nTEXT:\n"
        ),
        _head(text, limit),
    )


def parse_profile(reply: Column) -> Column:
    """``struct<register, narration, dialogue>`` from labelled lines; the last line of a label counts."""
    lines = F.split(reply, "\r?\n")

    def value(label: str) -> Column:
        hits = F.filter(lines, lambda x: F.lower(X.strip(x)).startswith(label + ":"))
        return F.coalesce(X.strip(F.regexp_extract(F.get(hits, F.size(hits) - 1), "(?s)^[^:]*:(.*)$", 1)), F.lit("")).alias(label)

    return F.struct(value("register"), value("narration"), value("dialogue"))


def tendencies_prompt(mtl: Column, original: Column, limit: int | None = 1500) -> Column:
    """Asks how a translator edited a text; ``limit``: characters of each side that the model sees, None for all."""
    return F.concat(
        F.lit("List how the human translation (B) edits the machine translation (A), one 'LABEL: description' per line.\n(A)\n"),
        _head(mtl, limit), F.lit("\n(B)\n"), _head(original, limit),
    )


def parse_tendencies(reply: Column) -> Column:
    """``array<struct<label, description>>``; a repeated label keeps its place and its last description."""
    lines = F.filter(F.transform(F.split(reply, "\r?\n"), X.strip), lambda x: F.contains(x, F.lit(":")) & ~x.startswith("#"))
    pairs = F.filter(
        F.transform(
            lines,
            lambda x: F.struct(
                X.strip(F.substring_index(x, ":", 1)).alias("label"), X.strip(F.regexp_replace(x, "(?s)^[^:]*:", "")).alias("description")
            ),
        ),
        lambda p: (p["label"] != "") & (p["description"] != ""),
    )

    def by_label(ps: Column) -> Column:
        def last(label: Column) -> Column:
            same = F.filter(ps, lambda p: p["label"] == label)
            return F.get(same, F.size(same) - 1)

        return F.transform(F.array_distinct(F.transform(ps, lambda p: p["label"])), last)

    return X.let(pairs, by_label)


def profile_lines(profile: Column, tendencies: Column, quotes: Column, metrics: Column, max_exemplars: int = 15) -> Column:
    """A profile as prompt lines.  ``quotes`` is array<struct<scene,text>>, ``metrics`` array<struct<name,value>>."""
    labelled = F.array(
        *[
            F.when(profile[field] != "", F.concat(F.lit(f"{title}: "), profile[field]))
            for field, title in (("register", "Register"), ("narration", "Narration"), ("dialogue", "Dialogue"))
        ]
    )
    measured = F.array_join(F.transform(metrics, lambda m: F.format_string("%s=%.2f", m["name"], m["value"])), "; ")
    return F.concat(
        F.array_compact(labelled),
        F.transform(tendencies, lambda t: F.concat(F.lit("Tendency ("), t["label"], F.lit("): "), t["description"])),
        F.transform(F.slice(quotes, 1, max_exemplars), lambda q: F.concat(F.lit("["), q["scene"], F.lit("] "), q["text"])),
        X.only_if(F.size(metrics) > 0, lambda: F.array(F.concat(F.lit("Measured: "), measured))),
    )


def model_profiles(texts: DataFrame, model_fn: Callable[[list[str]], Sequence[str]], limit: int | None = 2000) -> DataFrame:
    """``texts`` with the model's ``profile`` of column ``text``, its style metrics and the ``error`` of a failed call.

    Empty fields of a profile are empty texts; a failed call has an empty profile.
    """
    said = call_model(texts.withColumn("_prompt", profile_prompt(F.coalesce("text", F.lit("")), limit)), "_prompt", model_fn)
    return stylometry(said.withColumn("profile", parse_profile(F.coalesce("reply", F.lit("")))).drop("_prompt", "reply"))


def model_tendencies(pairs: DataFrame, model_fn: Callable[[list[str]], Sequence[str]], limit: int | None = 1500) -> DataFrame:
    """``pairs`` with the ``tendencies`` that the model finds between columns ``mtl`` and ``original``, and ``error``.

    A failed call has no tendencies.
    """
    prompt = tendencies_prompt(F.coalesce("mtl", F.lit("")), F.coalesce("original", F.lit("")), limit)
    said = call_model(pairs.withColumn("_prompt", prompt), "_prompt", model_fn)
    return said.withColumn("tendencies", parse_tendencies(F.coalesce("reply", F.lit("")))).drop("_prompt", "reply")
