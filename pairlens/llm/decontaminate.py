"""Benchmark decontamination by template windows (DataFrame functions only).

Texts are reduced to templates: numbers, names and units become typed
placeholders, all other words are lower-cased.  Windows of five template words
are hash-joined with those of the benchmark.  A document holds an item when
windows in the item's order, with any number of words between them, cover 80 %
of the item's, and either the words
are the item's own or the slots agree: along one alignment every value of the
item must stand for one value of the document and a tenth of the words or more
must be content words that both have, which finds a question asked again with
other numbers and names and leaves alone texts that merely share its phrases.

What a word stands for depends on its own text and on fixed lists alone, so other
documents never change what is found in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import small_side, stored

WINDOW = 5
#: Least share of an item's windows that a document must hold.
SHARE = 0.8
#: Least share of content words among an alignment's words if its values are others than the item's.
CONTENT = 0.1

#: Words that are units when they follow a number.
UNITS = """kg g mg t lb lbs oz km m cm mm mi ft yd inch inches l ml cl s ms min h hr hrs kmh mph usd eur gbp
    dollar dollars euro euros pound pounds cent cents percent degree degrees meter meters metre metres
    kilometer kilometers kilometre kilometres mile miles foot feet gram grams kilogram kilograms liter liters
    litre litres second seconds minute minutes hour hours day days week weeks month months year years""".split()

#: Words that begin questions and sentences.
OPENERS = """a after all an and are as at before but by can did do does each every find for from give had has have he her
    his how i if in is it its let many my no not of on or our she so some that the their then there these they this
    those to was we were what when where which while who whom whose why will with you your der die das ein eine wenn
    wie was wer wo el la los las un una si que quien como cuando donde cuantos le les une quel quelle quand comment
    combien qui""".split()

#: Words that tell nothing of what a sentence is about, besides those above.
FUNCTION = """about above again also among another any are around because been being below between both could down during either
    few further here into itself just like many may might more most much must neither nor now off once only other out over own
    same shall should since such than too under until up upon very was were whether within without would aber alle allem
    allen aller als also am an andere auch auf aus bei bis dann dass dem den denn des dich dir doch dort durch einem einen einer
    eines euch für gegen habe haben hat hatte hier ich ihm ihn ihr ihre im ist jede jedem jeden jeder jedes kann kein keine man
    mehr mein mich mir mit muss nach nicht noch nun nur oder ohne sehr sein seine sich sie sind so über um und uns unter viel
    viele vielen vom von vor war waren warum weil welche welcher welches wenn werden wie wieder wir wird wurde zu zum zur
    zwischen al algo como con cual cuales cuanta cuantas cuanto de del desde donde entre era eran es esa ese eso esta este esto
    estos fue ha hay hasta lo mas más me mi muy ni nos o otra otro para pero por porque qué se sea ser sin sobre son su sus
    también te tiene todo todos y ya au aux avec ce ces cette dans des du elle en et eux il ils je leur lui ma mais même mes
    moi mon ne nos notre nous on ou où par pas plus pour sa sans ses son sont sous sur ta tes toi ton tous tout très tu un vos
    votre vous est été être avoir""".split()

_MARK, _OPENING = "\x01", "\x02"
# A capitalised word inside a sentence: after a small letter or comma and one blank.
_NAME = r"(?<=[\p{Ll},;] )\p{Lu}\p{Ll}+"
# A capitalised word anywhere else.
_CAPITAL = rf"\p{{Lu}}(?<![\p{{L}}\p{{N}}{_MARK}]\p{{Lu}})\p{{Ll}}+"


def _once(df: DataFrame, *exprs: str) -> DataFrame:
    """Evaluate ``exprs`` once per row; the generator keeps them out of later lambdas."""
    return df.selectExpr(f"inline(array(struct({', '.join(exprs)})))")


def _listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in sorted(set(words)))


def templates(rows: DataFrame, key: str) -> DataFrame:
    """(key, words, literal, inside, named): a row's words and what each stands for, at equal places.

    ``literal`` has placeholders for numbers and units, ``inside`` for names
    inside sentences too, ``named`` also for capitalised words anywhere else
    that are not among the usual ``OPENERS``.  A text most of whose words look like names is in title case, and its words
    are taken literally.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = F.when(text.rlike(r"\d[.,]\d"), F.regexp_replace(text, r"(?<=\d)[.,](?=\d)", "")).otherwise(text)
    joined = F.regexp_replace(F.regexp_replace(joined, _NAME, _MARK + "$0"), _CAPITAL, _OPENING + "$0")
    out = _once(rows.select(F.col(key).cast("long").alias(key), F.lower(joined).alias("t")),
                key, rf"array_remove(split(t, r'[^\p{{L}}\p{{N}}{_MARK}{_OPENING}]+'), '') as raw")
    out = _once(out, key, "raw", f"transform(raw, x -> ltrim('{_MARK}{_OPENING}', x)) as words",
                f"2 * size(filter(raw, x -> startswith(x, '{_MARK}'))) > size(raw) as titled")
    out = _once(out, key, "raw", "words", "titled", f"""transform(words, (x, i) -> case
        when x >= '0' and x < ':' then '<number>'
        when i > 0 and words[i - 1] >= '0' and words[i - 1] < ':' and x in ({_listed(UNITS)}) then '<unit>'
        else x end) as literal""")
    out = _once(out, key, "words", "literal", f"""if(titled, literal, transform(raw, (x, i) ->
        if(startswith(x, '{_MARK}'), '<name>', literal[i]))) as inside""", f"""transform(raw, (x, i) ->
        if(startswith(x, '{_MARK}') or (startswith(x, '{_OPENING}') and not words[i] in ({_listed(OPENERS)})), '<name>', literal[i])) as named""")
    return _once(out, key, "words", "literal", "inside",
                 "if(2 * size(filter(named, x -> x = '<name>')) > size(named), literal, named) as named")


#: The readings of a text whose windows are hashed, the usual one first.
READINGS = ["inside", "literal", "named"]


def _hashed(templated: DataFrame) -> DataFrame:
    """The templates of texts with a window, and the hash of each word of each reading."""
    usual = READINGS[0]
    out = _once(templated.where(F.size("words") >= WINDOW), *templated.columns, f"transform({usual}, x -> xxhash64(x)) as {usual}_hash")
    return _once(out, *out.columns, *[f"if({r} = {usual}, cast(null as array<bigint>), transform({r}, (x, i) -> "
                                      f"if(x = {usual}[i], {usual}_hash[i], xxhash64(x)))) as {r}_hash" for r in READINGS[1:]])


def _read(reading: str, value: str) -> str:
    """SQL for an array with ``value`` of each window (``i`` its place, ``w`` its hash) that a reading adds to the usual one."""
    usual = READINGS[0]
    places = f"sequence(0, size(words) - {WINDOW})" if reading == usual else f"""if({reading}_hash is null, cast(array() as array<int>),
        array_distinct(flatten(transform(filter(sequence(0, size(words) - 1), i -> {reading}_hash[i] != {usual}_hash[i]),
            i -> sequence(greatest(i - {WINDOW - 1}, 0), least(i, size(words) - {WINDOW}))))))"""
    w = f"xxhash64({', '.join(f'{reading}_hash[i + {j}]' for j in range(WINDOW))})"
    return f"transform({places}, i -> {value.format(w=w, reading=reading)})"


def window_set(templated: DataFrame, key: str) -> DataFrame:
    """(key, window): the hashes of a row's windows, in each reading in which they differ."""
    parts = ", ".join(_read(r, "{w}") for r in READINGS)
    return _hashed(templated).selectExpr(key, f"explode(concat({parts})) as window")


def windows(templated: DataFrame, key: str) -> DataFrame:
    """(key, place, window, said, kinds): every window with its five words and what they stand for."""
    value = (f"named_struct('place', i, 'window', {{w}}, 'said', slice(words, i + 1, {WINDOW}), "
             f"'kinds', slice({{reading}}, i + 1, {WINDOW}))")
    return _hashed(templated).selectExpr(key, f"inline(concat({', '.join(_read(r, value) for r in READINGS)}))")


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, item_place, window, asked, kinds) of the benchmark.

    Windows of placeholders only, which any row of numbers or names has, count
    only in items that have no other.
    """
    own = windows(templates(items, "item_id"), "item_id").select(
        "item_id", F.col("place").alias("item_place"), "window", F.col("said").alias("asked"), "kinds",
        F.forall("kinds", lambda x: x.isin("<name>", "<number>", "<unit>")).alias("bare")).distinct()
    own = stored(own, "item-windows")
    only = own.groupBy("item_id").agg(F.min("bare").alias("only")).where("only").select("item_id", "only")
    return own.join(only, "item_id", "left").where("not bare or only").drop("bare", "only")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, share and kind of every benchmark item that a document holds.

    ``kind`` is ``verbatim`` or ``reparameterised`` (other numbers, names or
    units).  Only documents with a finding have rows; an item that stands in a
    document more than once is found once.  A null text has no words; items of
    fewer than five words have no window and are never found; rows without
    doc_id or item_id are not looked at; rows that repeat an id are read as
    parts of one text or item; empty tables give an empty result; other columns
    are ignored.
    """
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    items = stored(item_windows(benchmark.where("item_id is not null").select("item_id", "text")), "asked-windows")
    totals = items.groupBy("item_id").agg(F.countDistinct("item_place").alias("total"))
    known = stored(items.select("item_id", "item_place", "window").distinct(), "known-windows")
    hits = window_set(templates(texts, "doc_id"), "doc_id").join(small_side(known), "window")
    held = hits.select("doc_id", "item_id", "item_place").distinct().groupBy("doc_id", "item_id").agg(
        F.count(F.lit(1)).alias("n_windows"))
    held = held.join(totals, "item_id").where(F.col("n_windows") >= SHARE * F.col("total"))
    held = stored(held.select("doc_id", "item_id", "total"), "held-items")
    best = _aligned(held, texts, items).groupBy("doc_id", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.max("share").alias("share"),
        F.max_by("kind", F.struct("n_windows", "kind")).alias("kind"))
    return best.select("doc_id", "item_id", F.col("n_windows").cast("long").alias("n_windows"), "share", "kind")


def _aligned(held: DataFrame, texts: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, share and kind of each alignment that shows an item of ``held`` in its document.

    Either the item's own words stand in the document in the item's order, or
    there is an alignment on which every item value stands for one value of the
    document: each item place has the document place on the main diagonal, or
    the nearest to it where the diagonal has none.
    """
    pair = ["doc_id", "item_id"]
    read = stored(templates(texts.join(held.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id"), "held-texts")
    asked = stored(items.join(held.select("item_id").distinct(), "item_id", "left_semi"), "asked-items")
    size = F.expr("100 + aggregate(concat(asked, kinds), 0L, (n, x) -> n + octet_length(x))")
    hits = (windows(read, "doc_id").drop("kinds").join(small_side(asked, size), "window")
            .join(held, pair).selectExpr(*pair, "total", "item_place", "place", "place - item_place as shift", "said = asked as same",
                                         f"""filter(transform(sequence(0, {WINDOW - 1}), j -> named_struct('slot', kinds[j],
                'item_value', asked[j], 'value', said[j])), x -> x.slot in ('<name>', '<number>', '<unit>')) as slots""",
                                         f"""transform(sequence(0, {WINDOW - 1}), j -> named_struct('at', item_place + j, 'content',
                length(kinds[j]) > 2 and not kinds[j] in ('<name>', '<number>', '<unit>', {_listed(OPENERS + FUNCTION)}))) as read"""))
    hits = stored(hits, "held-windows")
    enough = F.col("n_windows") >= SHARE * F.col("total")
    # The longest row of literal windows that rises in both texts: of each length the least end.
    literal = hits.where("same").groupBy(*pair, "total").agg(F.sort_array(F.collect_set(
        F.expr("struct(item_place, -place as back)"))).alias("h"))
    literal = literal.select(*pair, "total", F.expr("""size(aggregate(h, cast(array() as array<int>), (t, x) -> concat(
        filter(t, y -> y < -x.back), array(-x.back), slice(filter(t, y -> y >= -x.back), 2, size(t) + 1)))) as n_windows"""))
    literal = stored(literal.where(enough), "literal-items")

    rest = hits.join(literal.where("n_windows = total").select(*pair), pair, "left_anti")
    main = rest.groupBy(*pair, "total", F.col("shift").alias("main")).agg(F.countDistinct("item_place").alias("n_windows"))
    # Each break costs windows, so a copy with 80 % of them has few breaks and one long diagonal; half of it
    # is asked for, as chance can save windows at a break.
    least = SHARE * F.col("total") / ((1 - SHARE) * F.col("total") / (WINDOW - 1) + 1) / 2
    main = stored(main.where(F.col("n_windows") >= least), "main-diagonals")
    whole = main.where(enough).drop("total", "n_windows").join(rest.withColumn("main", F.col("shift")), [*pair, "main"])
    near = main.where(~enough).drop("total", "n_windows").join(rest, pair).groupBy(*pair, "total", "main", "item_place").agg(
        F.min_by("place", F.struct(F.abs(F.col("shift") - F.col("main")), "place")).alias("place"))
    near = near.groupBy(*pair, "total", "main").agg(F.sort_array(F.collect_list(F.struct("item_place", "place"))).alias("h"))
    near = near.select(*pair, "total", "main", F.expr("""aggregate(h,
        cast(array() as array<struct<place: int, row: array<struct<item_place: int, place: int>>>>),
        (t, x) -> concat(filter(t, y -> y.place < x.place), array(named_struct('place', x.place, 'row', concat(
            coalesce(get(filter(t, y -> y.place < x.place), size(filter(t, y -> y.place < x.place)) - 1).row,
                     cast(array() as array<struct<item_place: int, place: int>>)), array(x)))),
            slice(filter(t, y -> y.place >= x.place), 2, size(t) + 1)),
        t -> get(t, size(t) - 1).row) as row"""))
    near = near.where(F.size("row") >= SHARE * F.col("total")).selectExpr(*pair, "main", "inline(row)")
    near = near.join(rest, [*pair, "item_place", "place"])
    columns = [*pair, "total", "main", "item_place", "slots", "read"]
    rows = stored(whole.select(columns).union(near.select(columns)), "alignments")
    counted = rows.groupBy(*pair, "total", "main").agg(F.countDistinct("item_place").alias("n_windows"))
    each = rows.selectExpr(*pair, "main", "inline(slots)").groupBy(*pair, "main", "slot", "item_value").agg(
        F.countDistinct("value").alias("values"), F.max(F.col("value") != F.col("item_value")).alias("other"))
    fits = each.groupBy(*pair, "main").agg(F.max("values").alias("values"), F.max("other").alias("other"))
    about = rows.selectExpr(*pair, "main", "inline(read)").groupBy(*pair, "main", "at").agg(F.max("content").alias("content"))
    about = about.groupBy(*pair, "main").agg(F.avg(F.col("content").cast("double")).alias("content"))
    again = counted.join(fits, [*pair, "main"], "left").join(about, [*pair, "main"]).where(
        (F.col("values").isNull() | (F.col("values") == 1)) & (~F.coalesce("other", F.lit(False)) | (F.col("content") >= CONTENT)))
    again = again.select(*pair, "total", "n_windows", F.when(F.col("other"), "reparameterised").otherwise("verbatim").alias("kind"))
    return literal.withColumn("kind", F.lit("verbatim")).unionByName(again).withColumn(
        "share", F.col("n_windows") / F.col("total"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    leaks = stored(find_leaks(docs, benchmark).select("doc_id").distinct(), "leaking-ids")
    return docs.join(small_side(leaks), "doc_id", "left_anti").select(*docs.columns)
