"""Finding known forms in chapters.

Text and forms are cut into the same tokens (a word, or one other character), so a whole-word match of a
form is an equal run of tokens.  Matching is then an equi-join of short token runs: broadcast by Spark when
the forms are few, shuffled by run otherwise.  No pattern is built from the forms and no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaloom.functions import text as X
from glossaloom.plans.lineage import SMALL_ROWS
from glossaloom.plans.ordered import first_rows

#: Boundary rules: ASCII letters and digits for retrieval, any word character for spans.
ASCII_TOKENS = "[a-z0-9]+|[^a-z0-9]"
WORD_TOKENS = r"(?U)\w+|\W"
#: Longest token run used as one join key; longer forms are matched as several runs in a row.
LONGEST_RUN = 9


def tokenise(text: Column, tokens: str) -> Column:
    return X.found(F.lower(text) if tokens == ASCII_TOKENS else text, tokens)


def _is_word(token: Column, tokens: str) -> Column:
    return F.coalesce(token.rlike("^[a-z0-9]" if tokens == ASCII_TOKENS else r"(?U)^\w"), F.lit(False))


def _runs(forms: DataFrame, keys: list[str], tokens: str) -> DataFrame:
    """Token runs of each form: ``keys, n, offset, run, n_runs``."""
    cut_form = forms.where("form <> ''").select(*keys, tokenise(F.lower("form"), tokens).alias("_t")).withColumn("n", F.size("_t"))
    offsets = F.when(F.col("n") <= LONGEST_RUN, F.array(F.lit(0))).otherwise(
        F.array_distinct(F.concat(F.sequence(F.lit(0), F.col("n") - LONGEST_RUN, F.lit(LONGEST_RUN)), F.array(F.col("n") - LONGEST_RUN)))
    )
    return (
        cut_form.withColumn("_o", offsets)
        .select(*keys, "n", "_t", F.size("_o").alias("n_runs"), F.explode("_o").alias("offset"))
        .select(*keys, "n", "n_runs", "offset", F.array_join(F.slice("_t", F.col("offset") + 1, LONGEST_RUN), "").alias("run"))
    )


def find_forms(
    texts: DataFrame, forms: DataFrame, form_keys: list[str], tokens: str = WORD_TOKENS, at: list[str] | None = None, places: bool = True
) -> DataFrame:
    """``novel, *at, *form_keys, first, last, shown`` for each whole-word match, ignoring case: 1-based token
    places and the matched text.

    ``texts`` has ``novel, *at, text``; ``forms`` has ``novel, *form_keys, form``.  With ``places=False`` each
    text lists a run once, so the result says which forms occur, not where.
    """
    at = at or ["chapter"]
    keys = ["novel", *form_keys]
    runs = _runs(forms.select(*keys, "form").distinct(), keys, tokens)
    # One small summary of the forms decides the plan: run sizes (at most LONGEST_RUN of them), whether any
    # form opens with a non-word character or needs several runs, and whether the runs may be broadcast.
    shape = runs.agg(
        F.array_sort(F.collect_set(F.least("n", F.lit(LONGEST_RUN)))).alias("sizes"),
        F.max(~_is_word(F.col("run"), tokens)).alias("odd"),
        F.max(F.col("n_runs") > 1).alias("long"),
        F.count("*").alias("rows"),
    ).collect()[0]
    few = shape["rows"] <= SMALL_ROWS
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    sizes = shape["sizes"] or [1]

    # Arrays as long as a text are only ever indexed: ``slice`` copies its whole input on every call.
    def at_tokens(body):
        """``body(tokens, is_word, places)`` over the tokens of a text and the places where a run may start."""

        def with_tokens(ts: Column) -> Column:
            def with_kinds(ws: Column) -> Column:
                start = F.filter(F.sequence(F.lit(1), F.size(ts)), lambda i: F.lit(bool(shape["odd"])) | F.get(ws, i - 1))
                return X.only_if(F.size(ts) > 0, lambda: body(ts, ws, start))

            return X.let(F.transform(ts, lambda t: _is_word(t, tokens)), with_kinds)

        return X.let(tokenise(F.col("text"), tokens), with_tokens)

    def joined(ts: Column, i: Column, k: int) -> Column:
        return F.get(ts, i - 1) if k == 1 else F.concat(*[F.get(ts, i - 1 + j) for j in range(k)])

    def opens(ws: Column, i: Column) -> Column:
        return F.get(ws, i - 1) | ~F.coalesce(F.get(ws, i - 2), F.lit(False))

    def closes(ws: Column, last: Column) -> Column:
        return F.get(ws, last - 1) | ~F.coalesce(F.get(ws, last), F.lit(False))

    def bounded(ts: Column, ws: Column, start: Column) -> Column:
        def of_size(k: int) -> Column:
            fits = F.filter(start, lambda i: (i + k - 1 <= F.size(ts)) & opens(ws, i) & closes(ws, i + k - 1))
            return F.transform(
                fits, lambda i: X.let(joined(ts, i, k), lambda shown: F.struct(i.alias("i"), F.lower(shown).alias("run"), shown.alias("shown")))
            )

        return F.concat(*[of_size(k) for k in sizes])

    def listed(ts: Column, ws: Column, start: Column) -> Column:
        runs_only = F.array_distinct(F.transform(bounded(ts, ws, start), lambda g: g["run"]))
        return F.transform(runs_only, lambda r: F.struct(F.lit(1).alias("i"), r.alias("run"), r.alias("shown")))

    grams = at_tokens(bounded if places else listed)
    text_runs = texts.select("novel", *at, F.explode(grams).alias("g")).select("novel", *at, "g.*")
    hits = text_runs.join(small(runs.where("n_runs = 1")), ["novel", "run"])
    found = hits.select("novel", *at, *form_keys, F.col("i").alias("first"), (F.col("i") + F.col("n") - 1).alias("last"), "shown")
    if not shape["long"]:
        return found

    # A long form is several full-size runs in a row; inner runs may end next to a word.
    def windows(ts: Column, ws: Column, _: Column) -> Column:
        def window(i: Column) -> Column:
            parts = F.array(*[F.get(ts, i - 1 + j) for j in range(LONGEST_RUN)])
            return F.struct(
                i.alias("i"), F.lower(joined(ts, i, LONGEST_RUN)).alias("run"), parts.alias("parts"),
                opens(ws, i).alias("opens"), closes(ws, i + LONGEST_RUN - 1).alias("closes"),
            )

        return F.transform(F.filter(F.sequence(F.lit(1), F.size(ts)), lambda i: i + LONGEST_RUN - 1 <= F.size(ts)), window)

    wide = texts.select("novel", *at, F.explode(at_tokens(windows)).alias("g")).select("novel", *at, "g.*")
    start = F.col("i") - F.col("offset")
    # The last run reaches back over the one before it, so only its last tokens are new.
    fresh = F.slice("parts", F.when(F.col("offset") + LONGEST_RUN < F.col("n"), 1).otherwise(LONGEST_RUN - (F.col("n") - 1) % LONGEST_RUN), LONGEST_RUN)
    long_found = (
        wide.join(small(runs.where("n_runs > 1")), ["novel", "run"])
        .where((F.col("offset") > 0) | F.col("opens"))
        .where((F.col("offset") + LONGEST_RUN < F.col("n")) | F.col("closes"))
        .groupBy("novel", *at, *form_keys, "n", "n_runs", start.alias("first"))
        .agg(F.count("*").alias("got"), F.array_sort(F.collect_list(F.struct("offset", F.array_join(fresh, "").alias("t")))).alias("pieces"))
        .where("got = n_runs")
        .select("novel", *at, *form_keys, "first", (F.col("first") + F.col("n") - 1).alias("last"), F.array_join("pieces.t", "").alias("shown"))
    )
    return found.unionByName(long_found)


def retrieve_policies(texts: DataFrame, policies: DataFrame, forms: DataFrame, k: int | None = None, order: str = "length") -> DataFrame:
    """``novel, chapter, policy_id, entry``: policies any of whose forms is in the chapter as a whole word.

    ``entry`` sorts by longest matched form, then store order.  ``k`` keeps the first k per chapter in that
    order, or by confidence when ``order='confidence'``.
    """
    ranked_forms = forms.join(policies.select("novel", "policy_id", "rank", "confidence"), ["novel", "policy_id"])
    hits = find_forms(texts, ranked_forms, ["policy_id", "pos", "form", "rank", "confidence"], ASCII_TOKENS, places=False)
    matched = hits.groupBy("novel", "chapter", "policy_id").agg(
        F.min(F.struct((-F.length("form")).alias("shorter"), "rank", "pos")).alias("entry"), F.max("confidence").alias("confidence")
    )
    if k is not None:
        by = [F.col("entry")] if order == "length" else [F.col("confidence").desc(), F.col("entry")]
        matched = first_rows(matched, ["novel", "chapter"], by, k)
    return matched.drop("confidence")


def find_spans(texts: DataFrame, policies: DataFrame, forms: DataFrame) -> DataFrame:
    """Every place a policy form stands as a whole word: ``novel, chapter, policy_id, pos, form, first, last, shown``."""
    return find_forms(texts, forms.join(policies.select("novel", "policy_id"), ["novel", "policy_id"], "left_semi"), ["policy_id", "pos", "form"])


#: Characters of the grams by which phrases of any kind are looked up in texts.
GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters, found in one pass over the text."""
    return F.array_distinct(X.found(text, f"(?s)(?=({'.' * size}))", 1))


def contains_join(texts: DataFrame, phrases: DataFrame, keys: list[str], phrase: str) -> DataFrame:
    """``texts`` rows with each phrase of their ``keys`` group that they contain, ignoring case.

    ``texts`` has ``keys, text`` (``keys`` may be empty); a phrase row that repeats counts once.  A phrase is looked up by the
    one of its trigrams that the fewest texts hold, so a text meets only phrases whose rarest trigram it has, and the
    candidates are verified.  The texts are read once to count trigrams and once to look them up; what is shuffled is one
    number and a trigram per candidate, never the list of phrases as a whole.
    """
    extra = [c for c in phrases.columns if c not in keys]
    known = phrases.where(F.col(phrase) != "").distinct().withColumn("_low", F.lower(phrase))
    size = F.least(F.length("_low"), F.lit(GRAM))
    # Phrases of one or two characters are looked up by themselves.
    sizes = sorted(r[0] for r in known.select(size).distinct().collect()) or [GRAM]
    rows = texts.withColumn("_row", F.xxhash64(*texts.columns))
    low = F.lower("text")
    in_texts = rows.select(*keys, "_row", F.explode(F.concat(*[_grams(low, n) for n in sizes])).alias("_gram"))
    counts = in_texts.groupBy(*keys, "_gram").agg(F.count("*").alias("_texts"))

    own = F.coalesce(*[F.when(size == n, _grams(F.col("_low"), n)) for n in sizes])
    in_phrases = known.select(*keys, "_low").distinct().withColumn("_gram", F.explode(own))
    # A phrase with a trigram that no text holds is in no text.
    rarest = (
        in_phrases.join(counts, [*keys, "_gram"], "left").groupBy(*keys, "_low")
        .agg(F.min_by("_gram", F.struct("_texts", "_gram")).alias("_gram"), F.count_if(F.col("_texts").isNull()).alias("_absent"))
        .where("_absent = 0").drop("_absent")
    )
    looked_up = known.join(rarest, [*keys, "_low"]).select(*keys, *extra, "_low", "_gram")
    candidates = in_texts.join(looked_up, [*keys, "_gram"]).select(*keys, "_row", *extra, "_low").distinct()
    return rows.join(candidates, [*keys, "_row"]).where(F.contains(low, F.col("_low"))).select(*texts.columns, *extra)
