"""Personal data replaced by surrogates, with DataFrame functions only.

Detected entities (mail addresses, telephone and payment-card numbers, network addresses, national numbers, account numbers, and names after a
title, with all mentions of these in the same text) are brought to a canonical form, so that all mentions of one entity, however written, get one surrogate.
A surrogate is drawn by a keyed hash and keeps the kind, the script, the length and the format: letters stay letters of their alphabet and case,
digits stay digits of theirs, a card keeps a valid check digit, an account number its country and valid check digits, a telephone number its calling code, a network address stays valid, and a given name comes from the names of the
title's gender. The surrogates of all entities are then checked against one another and against the entities themselves; those that collide
are drawn anew until all are distinct.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatorium.llm import spans
from curatorium.llm.shared import written

KEY = "curatorium"
ATTEMPTS = 40  # draws of a surrogate before its format counts as full
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_WORD = r"\p{Lu}[\p{L}'’-]{1,30}"
_MALE = r"Mr|Herr|Hr|Señor|Sr|Don|Monsieur|Г-н|Господин|κ|Κος"
_FEMALE = r"Mrs|Ms|Miss|Frau|Fr|Señora|Sra|Doña|Madame|Mme|Mlle|Г-жа|Госпожа|Κα"
_NEUTRAL = r"Dr|Prof|Mx"
_TITLE = rf"(?<![\p{{L}}-])(?:{_MALE}|{_FEMALE}|{_NEUTRAL})\.?\x20"


@dataclass(frozen=True)
class Kind:
    """A kind of entity: its expression and how its surrogates are made (`digits`, `account`, `card`, `address`, `hex`, `mail` or `name`). Expressions are bounded and do not nest repeats without an end, so a long run of whatever signs costs time in proportion to its length."""

    name: str
    pattern: str
    form: str


# Each expression first looks ahead at what is cheap to test, and then behind.
# Of overlapping entities the one that starts first stays; of those, the kind listed first.
KINDS = (
    Kind("email", r"[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,63}+", "mail"),
    Kind("account", r"(?=[A-Z]{2}[0-9]{2})(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "account"),
    Kind("card", r"(?=[0-9]{4})(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|3[47][0-9]{2}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9A-Za-z])", "card"),
    Kind(
        "phone",
        r"(?=[+(0-9])(?<![0-9A-Za-z+.])(?:\+(?=[0-9](?:[\x20.()-]{0,2}[0-9]){6})[0-9]{1,3}(?:[\x20.-]?\([0-9]{1,4}\))?(?:[\x20.-]?[0-9]{1,4}){2,5}|\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4}|0[0-9]{2,4}\x20[0-9]{3,4}\x20[0-9]{3,4})(?![0-9A-Za-z])",
        "digits",
    ),
    Kind("national", r"(?=[0-9]{3}-)(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "digits"),
    Kind("address", rf"(?=[0-9]{{1,3}}\.)(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])", "address"),
    Kind("address6", r"(?=[0-9A-Fa-f]{0,3}[0-9])(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])", "hex"),
    Kind("given_m", rf"(?=\p{{Lu}})(?<=(?<![\p{{L}}-])(?:{_MALE})\.?\x20){_WORD}(?=\x20{_WORD})", "name"),
    Kind("given_f", rf"(?=\p{{Lu}})(?<=(?<![\p{{L}}-])(?:{_FEMALE})\.?\x20){_WORD}(?=\x20{_WORD})", "name"),
    Kind("given_n", rf"(?=\p{{Lu}})(?<=(?<![\p{{L}}-])(?:{_NEUTRAL})\.?\x20){_WORD}(?=\x20{_WORD})", "name"),
    Kind("family", rf"(?=\p{{Lu}})(?<={_TITLE}(?:{_WORD}\x20){{0,1}}){_WORD}(?!\x20{_WORD})", "name"),
)

ALPHABETS = (
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    "àáâãäåçèéêëìíîïñòóôõöùúûüý", "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ",
    "٠١٢٣٤٥٦٧٨٩", "０１２３４５６７８９",
)

#: Calling codes of one and of two digits; all others have three.
CALLING_CODES = (
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)

#: Given names by gender, for names in Latin letters; in other scripts, and where more are needed, letters are drawn.
GIVEN = {
    "given_m": ("Alan", "Boris", "Carl", "David", "Emil", "Frank", "Georg", "Henry", "Ivan", "Jonas", "Kurt", "Louis", "Mario", "Nils", "Oscar", "Peter", "Ralph", "Simon", "Thomas", "Walter"),
    "given_f": ("Anna", "Bella", "Clara", "Diana", "Elsa", "Flora", "Greta", "Helena", "Irina", "Julia", "Karla", "Laura", "Maria", "Nora", "Olga", "Paula", "Rosa", "Sofia", "Teresa", "Vera"),
    "given_n": ("Alex", "Chris", "Dana", "Jamie", "Kim", "Lee", "Morgan", "Noel", "Robin", "Sascha"),
}


def _luhn(value: Column) -> Column:
    """The Luhn sum of a string of digits, from the right."""
    n = F.length(value)

    def part(i):
        d = F.substring(value, n - i, 1).cast("int")
        double = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 1, double).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), part), F.lit(0), lambda a, d: a + d)


def _check_digits(country: Column, rest: Column) -> Column:
    """The two digits that make an account number of a country valid: with letters as 10 to 35, the number read from its fifth sign on is 1 modulo 97."""
    turned = F.concat(rest, country, F.lit("00"))

    def step(left, i):
        c = F.substring(turned, i + 1, F.lit(1))
        letter = F.instr(F.lit(ALPHABETS[1]), c)
        return F.when(letter > 0, (left * 100 + letter + 9) % 97).otherwise((left * 10 + F.instr(F.lit(ALPHABETS[2]), c) - 1) % 97)

    return F.lpad((98 - F.aggregate(F.sequence(F.lit(0), F.length(turned) - 1), F.lit(0), step)).cast("string"), 2, "0")


def detected(docs: DataFrame) -> DataFrame:
    """docs with a column entities: (start, place, end, kind) of what is found, without overlaps, by start. Card numbers have a valid check digit."""
    docs = docs.drop("entities")
    text = F.coalesce("text", F.lit(""))
    rows = docs
    for k, kind in enumerate(KINDS):
        found = F.regexp_extract_all(text, F.lit(kind.pattern), 0)
        rows = rows.withColumn(f"_m{k}", F.when(F.contains(text, F.lit("@")), found) if kind.form == "mail" else found)
    for k, kind in enumerate(KINDS):
        rows = rows.withColumn(f"_p{k}", F.when(F.size(f"_m{k}") > 0, F.split(text, kind.pattern, -1)))
    found = []
    for k, kind in enumerate(KINDS):
        keep = F.transform(f"_m{k}", lambda m: _luhn(F.regexp_replace(m, "[^0-9]", "")) % 10 == 0) if kind.form == "card" else None
        found.append(F.coalesce(F.when(F.size(f"_m{k}") > 0, spans.spans(kind.name, k, F.col(f"_m{k}"), F.col(f"_p{k}"), keep)), spans.none()))
    rows = rows.withColumn("entities", F.array_sort(F.concat(*found)))
    zero = F.struct(F.lit(0).alias("at"), spans.none().alias("kept"))
    step = lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["kept"], F.array(s)).alias("kept"))).otherwise(acc)
    kept = F.aggregate("entities", zero, step, lambda acc: acc["kept"])
    rows = rows.withColumn("entities", F.when(F.size("entities") > 1, kept).otherwise(F.col("entities")))
    # Names found behind a title are looked for once more, wherever the text has them as words.
    titled = F.filter("entities", lambda s: s["kind"].isin([k.name for k in KINDS if k.form == "name"]))
    word = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    rows = rows.withColumn("_names", F.transform(titled, lambda s: F.struct(word(s).alias("name"), s["kind"].alias("kind"), s["place"].alias("place"))))
    again = F.concat(F.lit(r"(?<![\p{L}'’-])(?:"), F.array_join(F.array_distinct(F.col("_names.name")), "|"), F.lit(r")(?!\p{L}|['’-]\p{L}{2})"))
    rows = rows.withColumn("_again", F.when(F.size("_names") > 0, again))
    mentions = spans.spans("name", len(KINDS), F.regexp_extract_all(text, F.col("_again"), F.lit(0)), F.split(text, F.col("_again"), -1))

    def known(s):
        first = F.filter("_names", lambda n: n["name"] == word(s))[0]
        return F.struct(s["start"].alias("start"), first["place"].alias("place"), s["end"].alias("end"), first["kind"].alias("kind"))

    rows = rows.withColumn("_mentions", F.when(F.size("_names") > 0, F.transform(mentions, known)))
    free = F.filter("_mentions", lambda s: ~F.exists("entities", lambda e: (e["start"] < s["end"]) & (s["start"] < e["end"])))
    rows = rows.withColumn("entities", F.when(F.size("_mentions") > 0, F.array_sort(F.concat("entities", free))).otherwise(F.col("entities")))
    return rows.select(*docs.columns, "entities")


def _form(form: str) -> Column:
    return F.col("kind").isin([k.name for k in KINDS if k.form == form])


def canonical(kind: Column, value: Column) -> Column:
    """What all mentions of one entity have in common."""
    names = {k.name: k.form for k in KINDS}
    digits, tight, lower = F.regexp_replace(value, "[^0-9]", ""), F.regexp_replace(value, r"\x20", ""), F.lower(value)
    numbers = [k for k, f in names.items() if f in ("digits", "card")]
    called = F.when(value.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)
    return F.when(kind == "phone", called).when(kind.isin(numbers), digits).when(kind == "account", tight).when(kind.isin("email", "address6"), lower).otherwise(F.when(kind == "address", value).otherwise(F.initcap(lower)))


def _drawn(key: str, attempt: Column) -> Column:
    """64 hexadecimal digits drawn for the columns kind and canon."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.col("kind"), F.col("canon"), attempt.cast("string")), 256)


def _number(hexes: Column, i: Column, width: int = 4) -> Column:
    """A number from the i-th place of the drawn digits; past the end, from a digest of their digest."""
    far = F.sha2(F.concat(hexes, F.floor(i * width / 56).cast("string")), 256)
    return F.conv(F.substring(far, (i * width) % 56 + 1, F.lit(width)), 16, 10).cast("int")


def _like(value: Column, hexes: Column) -> Column:
    """Each letter or digit of value replaced by one of its alphabet."""

    def one(i):
        c = F.substring(value, i + 1, F.lit(1))
        out = c
        for alphabet in reversed(ALPHABETS):
            out = F.when(F.instr(F.lit(alphabet), c) > 0, F.substring(F.lit(alphabet), _number(hexes, i) % len(alphabet) + 1, F.lit(1))).otherwise(out)
        return out

    return F.when(F.length(value) == 0, value).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.length(value) - 1, F.lit(0))), one), ""))


def _surrogate(key: str, attempt: Column) -> Column:
    """The surrogate of canon at that attempt, in canonical form. From the fifth attempt on it grows, so a free one is always found."""
    canon, hexes = F.col("canon"), F.col("hexes")
    more = F.when(attempt > 4, F.substring(_like(F.lit("aaaaaaaaaaaa"), hexes), F.lit(1), attempt - 4)).otherwise(F.lit(""))
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    mail = F.concat(_like(local, hexes), more, F.lit("@"), _like(host, F.sha2(F.concat(F.lit(key), domain), 256)), F.lit("."), top)
    stem = _like(F.substring(canon, F.lit(1), F.length(canon) - 1), hexes)
    check = (10 - _luhn(F.concat(stem, F.lit("0"))) % 10) % 10
    code = F.when(canon.startswith("+"), F.regexp_extract(canon, rf"^\+(?:{'|'.join(CALLING_CODES)}|[0-9]{{3}})", 0)).otherwise(F.lit(""))
    numbers = F.concat(code, _like(F.substring(canon, F.length(code) + 1, F.length(canon)), hexes))
    country, rest = F.substring(canon, 1, 2), _like(F.substring(canon, F.lit(5), F.length(canon)), hexes)
    account = F.concat(country, _check_digits(country, rest), rest)
    hexadecimal = F.array_join(F.transform(F.sequence(F.lit(0), F.length(canon) - 1), lambda i: F.when(F.substring(canon, i + 1, F.lit(1)) == ":", ":").otherwise(F.substring(F.lit("0123456789abcdef"), _number(hexes, i) % 16 + 1, F.lit(1)))), "")
    card = F.concat(stem, check.cast("string"))
    address = F.concat_ws(".", *[(_number(hexes, F.lit(i)) % (223 if not i else 256) + (1 if not i else 0)).cast("string") for i in range(4)])
    latin = canon.rlike("^[A-Za-zÀ-ÿ'’-]+$")
    name = F.initcap(_like(F.lower(canon), hexes))
    for kind, names in GIVEN.items():
        listed = F.element_at(F.array(*map(F.lit, names)), _number(hexes, F.lit(9)) % len(names) + 1)
        name = F.when((F.col("kind") == kind) & latin & (attempt == 0), listed).otherwise(name)
    out = F.when(_form("mail"), mail).when(_form("card"), card).when(_form("address"), address).when(_form("name"), F.concat(name, more)).when(_form("account"), account).when(_form("hex"), hexadecimal)
    return out.otherwise(numbers)


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, surrogate, distinct) for the distinct (kind, canon) of entities: within a kind no two surrogates are equal and none is an entity of that kind.

    Entities whose draw is taken by another, or is an entity itself, draw again; each round settles all but the few that collide anew. Where ATTEMPTS draws
    find no free one, as when a format has fewer values than a corpus has entities of it, the last draw stays and distinct is false.
    """
    pending = written(entities.select("kind", "canon").distinct())
    taken = pending.select("kind", F.col("canon").alias("surrogate"))
    done, attempt = [], 0
    while True:
        drawn = pending.repartition("kind", "canon").withColumn("hexes", _drawn(key, F.lit(attempt)))  # few bytes, but much to compute
        drawn = drawn.select("kind", "canon", _surrogate(key, F.lit(attempt)).alias("surrogate"))
        winner = drawn.join(taken, ["kind", "surrogate"], "left_anti").groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        settled = written(winner.select("kind", "canon", "surrogate", F.lit(True).alias("distinct")))
        done.append(settled)
        pending = written(pending.join(settled, ["kind", "canon"], "left_anti"))
        if pending.isEmpty():
            break
        if attempt + 1 >= ATTEMPTS:
            done.append(pending.withColumn("hexes", _drawn(key, F.lit(attempt))).select("kind", "canon", _surrogate(key, F.lit(attempt)).alias("surrogate"), F.lit(False).alias("distinct")))
            break
        taken = taken.unionByName(settled.select("kind", "surrogate"))
        attempt += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _rendered(value: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate written as the mention was: its digits in the mention's places, its letters in the mention's cases."""

    def place(i):
        c = F.substring(value, i + 1, F.lit(1))
        nth = F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]"), F.substring(F.regexp_replace(surrogate, "^[+]", ""), nth, F.lit(1))).otherwise(c)

    def tight(i):
        c = F.substring(value, i + 1, F.lit(1))
        nth = F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), r"\x20", ""))
        return F.when(c == " ", c).otherwise(F.substring(surrogate, nth, F.lit(1)))

    def case(i):
        c, s = F.substring(value, i + 1, F.lit(1)), F.substring(surrogate, i + 1, F.lit(1))
        return F.when((c == F.upper(c)) & (c != F.lower(c)), F.upper(s)).otherwise(s)

    places = F.sequence(F.lit(0), F.length(value) - 1)
    numbers = [k.name for k in KINDS if k.form in ("digits", "card")]
    mail = F.concat(F.array_join(F.transform(places, case), ""), F.substring(surrogate, F.length(value) + 1, F.length(surrogate)))
    name = F.when((value == F.upper(value)) & (F.length(value) > 1), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin(numbers), F.array_join(F.transform(places, place), "")).when(kind == "account", F.array_join(F.transform(places, tight), "")).when(kind.isin("email", "address6"), mail).when(kind == "address", surrogate).otherwise(name)


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with text in which every entity is replaced by its surrogate, and a column entities: (start, end, kind, surrogate) with places in the old text.

    Null and empty texts stay as they are. Rows that repeat a doc_id, or have none, are treated each by its own text; equal rows get equal texts.
    A column entities of docs is replaced; n_chars, if a column, is left. An empty table gives no rows.
    """
    columns = [c for c in docs.columns if c != "entities"]
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "doc_id", "text")
    text_id = F.xxhash64("text")
    seen = detected(docs.select("doc_id", "text"))
    value = lambda e: F.substring(F.col("text"), e["start"] + 1, e["end"] - e["start"])
    # Written before rows without entities are left out: as a filter, the search itself would be run again for each use of its result.
    seen = written(seen.select("doc_id", text_id.alias("_text_id"), F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["kind"].alias("kind"), value(e).alias("value"))).alias("entities")))
    one = seen.where(F.size("entities") > 0).select("doc_id", "_text_id", F.explode("entities").alias("e")).select("doc_id", "_text_id", "e.*")
    one = written(one.withColumn("canon", canonical(F.col("kind"), F.col("value"))).distinct())
    known = surrogates(one, key)
    new = one.join(known, ["kind", "canon"]).withColumn("new", _rendered(F.col("value"), F.col("kind"), F.col("surrogate")))
    changes = new.groupBy(F.col("doc_id").alias("_doc_id"), "_text_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "new"))).alias("_changes"))
    rows = docs.select("row", "doc_id", text_id.alias("_key")).join(changes, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("_key").eqNullSafe(F.col("_text_id")), "left")
    changed = F.when(F.size("_changes") > 0, spans.rebuilt(F.col("row.text"), F.col("_changes"))).otherwise(F.col("row.text"))
    row = [changed.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in columns]
    entities = F.coalesce("_changes", F.array().cast("array<struct<start:int,end:int,kind:string,new:string>>"))
    return rows.select(*row, entities.alias("entities"))
