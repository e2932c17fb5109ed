"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is the set of its five-word shingles (the whole line as one token if it
has fewer words), in lower case. Two lines match at a Jaccard similarity of
0.75 or more. Lines have the order (doc_id, text hash, line number); a line
goes if an earlier line matches it, and only then.

1. Equal lines are one class, with the position of the first.
2. A class can only match classes that share a token of its prefix, whatever
   order of all tokens the prefix follows. The first order is by a token's first
   word, longer words first: it tells a prefix without building the other
   tokens. A class whose prefix no other class shares has no match.
3. Classes that share enough tokens of their prefixes are pairs, joined on the
   tokens with at most CROWD lines; a pair is verified exactly. A match that
   shares too few of these is between two classes with enough crowded tokens.
4. Only among such classes all tokens are counted exactly and ordered by
   rarity. Prefixes in that order, with the length filter and the positional
   filter (what is left after a shared token must reach the needed overlap),
   give the pairs to verify.
5. Most lines of a group of near copies match its earliest or its heaviest
   member. They are compared with those first, so that only lines without a
   match by then are joined with all earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.tables import maybe_in, with_maybe
from tidewrack.session import discard, materialize

#: Words of a token.
WIDTH = 5
#: Tokens of the first prefixes that two matching lines share at least (fewer where they have fewer); 3 at most, as of four tokens a match can lack one.
MATCHES = 3
#: The order of words tells their bytes up to this many.
LONG = 16
#: A token in more lines than this is crowded: no join pairs the classes that have it.
CROWD = 32
#: A match: NUM * |union| <= DEN * |intersection|.
NUM, DEN = 3, 4


def _even_blanks(text: Column) -> Column:
    """Text in lower case with single spaces between words; most texts have no other blanks and skip the replacement."""
    odd = text.contains("  ")
    for blank in "\t\x0b\x0c\r":
        odd = odd | text.contains(blank)
    return F.lower(F.when(odd, F.regexp_replace(text, "[ \t\x0b\x0c\r]+", " ")).otherwise(text))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no, line (lower case, single spaces, trimmed), cls: the lines that have words."""
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))  # once a text and not once a line
    rows = hashed.select("doc_id", "text_hash", F.posexplode(F.split(_even_blanks(F.col("text")), "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.trim("line")).where("line <> ''")
    return rows.withColumn("cls", F.xxhash64("line"))


def _word_hashes(line: Column) -> Column:
    return F.transform(F.split(line, " "), lambda w: F.xxhash64(w))


def _word_keys(line: Column) -> Column:
    """The hashes of a line's words, shifted so that longer words tend to come first, as they are rarer and repeat less within a line."""
    return F.transform(F.split(line, " "), lambda w: F.call_function("shiftrightunsigned", F.xxhash64(w), F.least(F.octet_length(w), F.lit(LONG))))


def _token(at: Column) -> Column:
    """The hash of the token that starts at place ``at`` (from 0) of the word hashes ``h``."""
    return F.xxhash64(*[F.get(F.col("h"), at + k) for k in range(WIDTH)])


def first_prefixes(lines: DataFrame) -> DataFrame:
    """cls, asks, token: a prefix of every line of five words or more, by the order of the tokens' first words, by their keys.

    The tokens that start with one of the floor(n / 4) + MATCHES smallest
    distinct words are that many tokens at least, and the smallest ones. A match
    lacks at most floor(n / 4) of a line's tokens, so it has MATCHES of these, or
    ``asks`` if the line has fewer words to start with.
    """
    many = F.substring_index("line", " ", WIDTH - 1) != F.col("line")  # a filter on the hashes would compute them once more, as an inner explode would
    hashed = lines.where(many).select("cls", _word_keys(F.col("line")).alias("h"))
    places = F.size("h") - (WIDTH - 1)
    words = F.sort_array(F.array_distinct(F.slice("h", F.lit(1), places)))
    held = hashed.select("cls", "h", places.alias("n"), words.alias("w"))
    last = F.element_at("w", F.least(F.size("w"), F.floor(F.col("n") / DEN).cast("int") + MATCHES))
    held = held.select("cls", "h", "n", F.least(F.size("w"), F.lit(MATCHES)).alias("asks"), last.alias("last"))
    rows = held.select("cls", "asks", "h", "n", "last", F.posexplode_outer("h").alias("at", "word")).where("at < n and word <= last")
    return rows.select("cls", "asks", _token(F.col("at")).alias("token"))


def shared_tokens(prefixes: DataFrame) -> DataFrame:
    """cls, token, asks, crowded: the tokens of a class's prefix that other classes have too."""
    ends = prefixes.groupBy("token").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count(F.lit(1)).alias("rows")).where("low <> high")
    ends = materialize(ends.select("token", (F.col("rows") > CROWD).alias("crowded")), "line-shared-tokens")
    near, _ = maybe_in(prefixes, F.col("token"), ends, F.col("token"))
    return near.join(ends.hint("shuffle_hash"), "token").groupBy("cls", "token").agg(F.first("asks").alias("asks"), F.first("crowded").alias("crowded"))


def sharing(shared: DataFrame) -> DataFrame:
    """cls, needs, in_crowd: the classes that share as many tokens with other classes as a match would.

    ``needs`` is how many tokens that are not crowded a match shares at least,
    or 1; a class in the crowd can do with crowded ones alone.
    """
    held = shared.groupBy("cls").agg(F.count(F.lit(1)).alias("k"), F.max("asks").alias("asks"), F.count_if("crowded").alias("c")).where("k >= asks")
    return held.select("cls", F.greatest(F.col("asks") - F.col("c"), F.lit(1)).alias("needs"), (F.col("c") >= F.col("asks")).alias("in_crowd"))


def pairs_of(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, other: the pairs that share enough tokens which are not crowded, but for those inside the crowd.

    The tokens that a match shares are in both prefixes. All but the crowded
    ones are met here, so it has ``needs`` of both classes, or it shares crowded
    tokens only and both are in the crowd.
    """
    mine = shared.where("not crowded").join(classes, "cls").select("token", "cls", "needs", "in_crowd")
    theirs = mine.select("token", F.col("cls").alias("other"), F.col("needs").alias("wants"), F.col("in_crowd").alias("too"))
    met = mine.join(theirs, "token").where("cls < other and not (in_crowd and too)")
    counted = met.groupBy("cls", "other").agg(F.count(F.lit(1)).alias("k"), F.max(F.greatest("needs", "wants")).alias("least"))
    return counted.where("k >= least").select("cls", "other")


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "line_no")


def with_texts_of(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``lines`` with their text only where the class can be wanted, told by broadcast slots of bounded size."""
    marked = with_maybe(lines, F.col("cls"), wanted, F.col("cls"), "near")
    return marked.withColumn("line", F.when(F.col("near"), F.col("line"))).drop("near")


def candidates_of(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, in_crowd, first (position of the first such line), n, tokens: the wanted classes (cls, in_crowd)."""
    held = lines.where("line is not null").join(wanted, "cls").groupBy("cls")
    one = held.agg(F.first("in_crowd").alias("in_crowd"), F.min(_place()).alias("first"), F.first("line").alias("line"))
    hashed = one.select("cls", "in_crowd", "first", _word_hashes(F.col("line")).alias("h"))
    starts = F.slice("h", F.lit(1), F.size("h") - (WIDTH - 1))
    tokens = F.array_distinct(F.transform(starts, lambda _, i: _token(i)))  # a slice of h for every token would copy h every time
    return hashed.select("cls", "in_crowd", "first", tokens.alias("tokens")).select("cls", "in_crowd", "first", F.size("tokens").cast("long").alias("n"), "tokens")


def rare_prefixes(candidates: DataFrame) -> DataFrame:
    """token, cls, first, n, at, weight: the prefix of every candidate, its tokens ordered by how many candidates have them.

    Tokens that no other candidate has come first and meet nobody, so they only
    count as places. Candidates with too few shared tokens for any match have
    no row. ``weight`` is the mean frequency.
    """
    rows = candidates.select("cls", F.explode("tokens").alias("token"))
    counts = materialize(rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "line-token-counts")
    near, _ = maybe_in(rows, F.col("token"), counts, F.col("token"))
    lists = near.join(counts, "token").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("x"), F.sum("df").alias("total"))
    held = lists.join(candidates.select("cls", "first", "n"), "cls").where(DEN * F.size("x") >= NUM * F.col("n"))
    alone = F.col("n") - F.size("x")
    length = F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1 - alone
    prefix = F.slice("x", F.lit(1), F.greatest(length, F.lit(0)).cast("int"))
    ranked = held.select("cls", "first", "n", alone.alias("alone"), (F.col("total") / F.col("n")).alias("weight"), F.posexplode(prefix).alias("k", "t"))
    return ranked.select(F.col("t.token").alias("token"), "cls", "first", "n", (F.col("alone") + F.col("k")).alias("at"), "weight")


def _fits(na: Column, pa: Column, nb: Column, pb: Column) -> Column:
    """Length and positional filters for a token at places ``pa`` and ``pb`` of sets of ``na`` and ``nb``.

    Of a match, at least the first shared token passes: nothing before it is
    shared, so the overlap is at most what is left on either side.
    """
    return (DEN * F.least(na, nb) >= NUM * F.greatest(na, nb)) & ((NUM + DEN) * F.least(na - pa, nb - pb) >= NUM * (na + nb))


def matching(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """cls: the later ones of the pairs (cls, other) whose Jaccard similarity suffices."""
    mine = candidates.select("cls", "first", "n", "tokens")
    theirs = candidates.select(F.col("cls").alias("other"), F.col("first").alias("before"), F.col("n").alias("m"), F.col("tokens").alias("others"))
    both = pairs.select("cls", "other").join(mine, "cls").join(theirs, "other").where(DEN * F.least("n", "m") >= NUM * F.greatest("n", "m"))
    both = both.withColumn("common", F.size(F.array_intersect("tokens", "others")).cast("long"))
    both = both.where(DEN * F.col("common") >= NUM * (F.col("n") + F.col("m") - F.col("common")))
    return both.select(F.when(F.col("before") < F.col("first"), F.col("cls")).otherwise(F.col("other")).alias("cls")).distinct()


def with_earlier_match(candidates: DataFrame) -> DataFrame:
    """cls: the candidates that an earlier one matches."""
    prefix = materialize(rare_prefixes(candidates), "line-prefixes")
    me = F.struct("first", "cls", "n", "at")
    leads = prefix.groupBy("token").agg(F.min(me).alias("earliest"), F.max(F.struct("weight", me.alias("who"))).alias("heaviest"))
    met = prefix.join(leads, "token").select("cls", "first", "n", "at", F.explode(F.array(F.col("earliest"), F.col("heaviest.who"))).alias("lead"))
    met = met.where((F.col("lead.first") < F.col("first")) & _fits(F.col("n"), F.col("at"), F.col("lead.n"), F.col("lead.at")))
    counted = met.groupBy("cls", F.col("lead.cls").alias("other")).agg(F.count(F.lit(1)).alias("k"))
    most = counted.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list(F.struct("k", "other")), asc=False), 1, 2).alias("x"))
    first = materialize(matching(most.select("cls", F.explode("x.other").alias("other")), candidates), "lines-matched")
    left = prefix.join(first, "cls", "left_anti")
    right = prefix.select("token", F.col("cls").alias("other"), F.col("first").alias("before"), F.col("n").alias("m"), F.col("at").alias("there"))
    pairs = left.join(right, "token").where((F.col("before") < F.col("first")) & _fits(F.col("n"), F.col("at"), F.col("m"), F.col("there")))
    return first.unionAll(matching(pairs.select("cls", "other").distinct(), candidates))


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, removed (numbers from 0 of the lines to remove, ascending): only texts that lose lines."""
    prefixes = materialize(first_prefixes(lines_of(docs)), "line-tokens")
    shared = materialize(shared_tokens(prefixes), "line-shared")
    discard(prefixes)
    classes = materialize(sharing(shared), "line-classes")
    pairs = materialize(pairs_of(shared, classes), "line-pairs")
    crowd = classes.where("in_crowd").select("cls", "in_crowd")
    paired = pairs.select(F.explode(F.array("cls", "other")).alias("cls"), F.lit(False).alias("in_crowd"))
    found = materialize(paired.unionAll(crowd).groupBy("cls").agg(F.max("in_crowd").alias("in_crowd")), "line-found")
    lines = materialize(with_texts_of(lines_of(docs), found), "lines")
    candidates = materialize(candidates_of(lines, found), "line-candidates")
    matched = matching(pairs, candidates)
    if not crowd.isEmpty():
        crowded = materialize(candidates.where("in_crowd"), "line-crowd")
        matched = matched.unionAll(with_earlier_match(crowded)).distinct()
    matched = materialize(matched, "lines-matched").withColumn("matched", F.lit(True))
    places = lines.select("cls", "doc_id", "text_hash", "line_no")
    classes = places.groupBy("cls").agg(F.count(F.lit(1)).alias("rows")).join(matched, "cls", "left").where("rows > 1 or matched")
    near = materialize(places.join(classes.select("cls", "matched"), "cls"), "line-places")
    firsts = near.where("matched is null").groupBy("cls").agg(F.min(_place()).alias("first"))
    gone = near.join(firsts, "cls", "left").where(F.col("matched") | (_place() != F.col("first")))
    return gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def _join_texts(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Add removed to rows of _doc and _hash."""
    gone = gone.select(F.col("doc_id").alias("_doc_gone"), F.col("text_hash").alias("_hash_gone"), "removed")
    return rows.join(gone, F.col("_doc").eqNullSafe(F.col("_doc_gone")) & (F.col("_hash") == F.col("_hash_gone")), "left").drop("_doc_gone", "_hash_gone")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (array of line numbers from 0): one row per row of ``docs``.

    Null texts have no lines. Lines without words are never removed. Repeated
    rows share their positions, so they keep and lose the same lines; rows with
    a null doc_id come last. Very long texts are lines like others. Extra
    columns play no part. An empty table gives an empty result.
    """
    ends = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    rows = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash"), F.coalesce(ends + 1, F.lit(0)).alias("n_lines"))
    joined = _join_texts(rows, removed_lines(docs))
    return joined.select(F.col("_doc").alias("doc_id"), "n_lines", F.greatest(F.size("removed"), F.lit(0)).alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``; every row and column stays, whatever the columns' names.

    See ``report`` for odd rows. Only texts that may lose lines are shuffled:
    the others are told apart by a broadcast of bounded size.
    """
    gone = materialize(removed_lines(docs.select("doc_id", "text")), "removed-lines")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash"))
    hit, untouched = maybe_in(rows, F.col("_hash"), gone, F.col("text_hash"))
    edited = _join_texts(hit, gone)
    kept = F.array_join(F.filter(F.split("_row.text", "\n"), lambda _, i: ~F.array_contains("removed", i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("_row.text")).otherwise(kept)
    own = {c: F.col("_row").getField(c) for c in docs.columns}
    clean = edited.select(*[(text if c.lower() == "text" else x).alias(c) for c, x in own.items()])
    return untouched.select(*[x.alias(c) for c, x in own.items()]).unionByName(clean)
