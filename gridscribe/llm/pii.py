"""PII surrogates (operator 3). DataFrame functions only.

Detected entities get keyed replacements of their own kind: the same entity (whatever its punctuation or case) always gets the
same surrogate, so coreference survives; letters stay letters of their case, digits digits, hex digits hex digits, punctuation
its place; card numbers keep their first digit and whether they pass the Luhn test, bank accounts their country and whether
their check digits hold, phone numbers their country code or leading zero; names after an honorific get names of
the honorific's gender in the script of the original; e-mail hosts end in the reserved example.com.

Collision checks keep distinct entities distinct: over the table of all distinct entities, a surrogate must not be another
entity's surrogate (of its kind) nor an entity that occurs (of any kind that looks alike). Of those that collide the most
frequent keeps its surrogate, the others draw again with the next salt, until none collides. From the salt `GROWS` on each
salt adds a character or a syllable, so a kind whose values are few (passwords of one digit) can't be exhausted and the
rounds end. The few entities with a salt are joined back to the texts that hold them, by a digest of the text. The entity table
is one aggregation over mentions; texts are shuffled only where salts exist and are too many to broadcast.

Every pattern starts at a boundary or has a bounded length, so a long unbroken run costs one pass.

Defined results: a null text stays null, an empty one empty; texts without entities come back unchanged; a password of
punctuation alone is a mask, not an entity; every other column comes back as it is, whatever its name; repeated rows are
replaced alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Kinds of entity and their patterns, in the order in which they are tried at a place.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,126}",
    "secret": r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)(?=[_./+-]*+[A-Za-z0-9])[A-Za-z0-9_./+-]{6,}",
    "key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "phone": r"(?:\+\d{1,3}[ .-]?|\b00\d{1,3}[ .-])\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}",
    "card": r"\b(?:3[47]\d{2}[ -]\d{6}[ -]\d{5}|[2-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7})\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "ip": r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b",
    "ip6": r"(?<![\w:.])(?=[A-Fa-f:]{0,38}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "local": r"(?<![\w.,:/+-])(?:\(0?\d{2,4}\)[ -]?\d{3,4}[ .-]?\d{3,4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|[2-9]\d{2} [2-9]\d{2} \d{4}|0\d{2,4}[ /]\d{3,4}(?:[ -]?\d{2,4}){1,2}|0\d{2,4}-\d{6,8})(?!\w|[.,-]\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}| [A-Z0-9]{4}(?: \d[A-Z0-9]{3}){2,6}(?: [A-Z0-9]{1,3})?)\b",
    "woman": r"\b(?:Mrs\.|Ms\.|Miss|Frau|Madame|Mme|Señora|Doña|Госпожа|Κυρία) \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){0,2}",
    "man": r"\b(?:Mr\.|Herr|Herrn|Monsieur|Señor|Don|Господин|Κύριος) \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){0,2}",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Every entity holds one of these, so texts without them skip the patterns.
HINT = r"[@\d]|AKIA|ASIA|Mrs|Ms\.|Miss|Frau|M(?:ada)?me|Señor|Do[nñ]|Mr\.|Herr|Monsieur|Госп|Κυρία|Κύριος|(?i:pass|pwd|token|secret|key)"
#: From this salt on surrogates grow.
GROWS = 3
#: What the queries take where the session's spark.gridscribe.pii.key is unset: for trials only, since anyone can read it here.
TRIAL_KEY = "no secret"
WOMEN = {"Latin": "Anna Clara Elena Julia Laura Marta Nina Sofia".split(), "Cyrillic": "Анна Вера Елена Ирина Мария Нина Ольга София".split(), "Greek": "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία Δήμητρα Ζωή".split()}
MEN = {"Latin": "Adam Bruno David Felix Lukas Martin Oscar Victor".split(), "Cyrillic": "Антон Борис Виктор Иван Максим Олег Павел Юрий".split(), "Greek": "Ανδρέας Γιώργος Δημήτρης Νίκος Πέτρος Σπύρος Θωμάς Κώστας".split()}
SYLLABLES = {"Latin": "ba de fi go lu ma ne pi ro su ta ve wi zo ka le".split(), "Cyrillic": "ба де фи го лу ма не пи ро су та ве ви зо ка ле".split(), "Greek": "βα δε φι γο λου μα νε πι ρο σου τα βε κι ζο κα λε".split()}


def mentions(text: Column) -> Column:
    """All entities of a text in order, non-overlapping."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))


def kind_of(m: Column) -> Column:
    out = F.lit("man")
    for kind, pattern in reversed(list(KINDS.items())):
        out = F.when(m.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def value_of(m: Column, kind: Column) -> Column:
    """The part that is replaced: a secret without what introduces it, a name without its honorific, a number without + or 00."""
    secret = F.regexp_extract(m, r"[A-Za-z0-9_./+-]{6,}$", 0)
    lead = F.regexp_extract(m, r"^(?i:(?:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)", 0)
    value = F.when(kind == "secret", F.when(lead != "", F.substring(m, F.length(lead) + 1, F.length(m))).otherwise(secret))
    return value.when(kind.isin("woman", "man"), F.regexp_replace(m, r"^\S+ ", "")).when(kind == "phone", F.regexp_replace(m, r"^(?:\+|00)", "")).otherwise(m)


def core_of(m: Column, kind: Column) -> Column:
    """What identifies an entity beside its kind."""
    value = value_of(m, kind)
    return F.when(kind.isin("email", "ip", "ip6", "woman", "man"), F.lower(value)).when(kind.isin("secret", "key", "iban"), F.regexp_replace(value, r"[^A-Za-z0-9]", "")).otherwise(F.regexp_replace(value, r"\D", ""))


def looks_of(kind: Column) -> Column:
    """Kinds whose values could be taken for each other."""
    return F.when(kind.isin("woman", "man"), "name").when(kind.isin("phone", "local", "card", "ssn"), "number").when(kind.isin("secret", "key", "iban"), "code").otherwise(kind)


def _let(value: Column, use) -> Column:
    """use(value) with value computed once: a transform over an array of one."""
    return F.get(F.transform(F.array(value), use), 0)


def _stream(key: str, kind: Column, core: Column, salt: Column, places: Column) -> Column:
    """Numbers 0..65535, as many as places or a few more, from keyed SHA-512 blocks."""

    def block(b: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), kind, core, salt.cast("string"), b.cast("string")), 512)
        return _let(digest, lambda h: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.conv(F.substring(h, j * 4 + 1, F.lit(4)), 16, 10).cast("int")))

    return F.flatten(F.transform(F.sequence(F.lit(0), (places / 32).cast("int")), block))


def _scrambled(core: Column, stream: Column, shift: int = 0) -> Column:
    """Each letter another letter of its case, each digit a digit; hex strings stay hex; other characters stay."""
    is_hex = core.rlike(r"^(?:[0-9a-f:]+|[0-9A-F:]+)$")

    def one(c: Column, i: Column) -> Column:
        n = F.get(stream, i + shift)
        low = lambda options: F.substring(F.lit(options), F.pmod(n, F.lit(len(options))) + 1, F.lit(1))
        letter = F.when(is_hex, low("abcdef")).otherwise(low(C.LOWER))
        return F.when(c.rlike("[0-9]"), low("0123456789")).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c)

    return F.array_join(F.transform(F.split(core, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum mod 10 of a string of digits."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10


def _mod97(text: Column) -> Column:
    """A string of digits and capitals as a number (A is 10, Z is 35), mod 97."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def surrogate(kind: Column, core: Column, salt: Column, key: str) -> Column:
    """The core of an entity's surrogate."""
    more = F.greatest(F.lit(0), salt - (GROWS - 1))
    pad = F.when(kind == "ip", ".0").when(kind == "ip6", ":0").when(core.rlike(r"^\d+$"), "0").otherwise(F.when(core == F.upper(core), "A").otherwise("a"))
    grown = F.when((more == 0) | kind.isin("woman", "man", "email"), core).otherwise(F.concat(core, F.repeat(pad, more)))
    return _let(grown, lambda core: _let(_stream(key, kind, core, salt, F.length(core) + 300), lambda stream: _from_stream(kind, core, salt, more, key, stream)))


def _from_stream(kind: Column, core: Column, salt: Column, more: Column, key: str, stream: Column) -> Column:
    scrambled = _scrambled(core, stream)
    # a card keeps its first digit and its validity: the last digit is the check digit, or for an invalid number another
    body = F.concat(F.substring(core, F.lit(1), F.lit(1)), F.substring(scrambled, F.lit(2), F.length(core) - 2))
    digit = lambda b: F.pmod(10 - _luhn(F.concat(b, F.lit("0"))), F.lit(10))
    card = _let(body, lambda b: F.concat(b, F.when(_luhn(core) == 0, digit(b)).otherwise((digit(b) + 1 + F.get(stream, F.length(core)) % 9) % 10).cast("string")))
    # an account keeps its country, and check digits that hold
    account, country = F.substring(scrambled, F.lit(5), F.length(core)), F.substring(core, F.lit(1), F.lit(2))
    holds = _mod97(F.concat(F.substring(core, F.lit(5), F.length(core)), F.substring(core, F.lit(1), F.lit(4)))) == 1
    iban = _let(account, lambda a: F.concat(country, F.when(holds, F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0")).otherwise(F.substring(scrambled, F.lit(3), F.lit(2))), a))
    octets = F.array_join(F.transform(F.split(core, r"\."), lambda o, i: (1 + F.get(stream, i) % 254).cast("string")), ".")
    local, labels = F.substring_index(core, "@", 1), F.split(F.substring_index(core, "@", -1), r"\.")
    inner = F.array_join(F.slice(labels, 1, F.greatest(F.lit(1), F.size(labels) - 2)), ".")
    long = F.concat(F.when(F.length(local) < 5, F.concat(local, F.lit("aaaa"))).otherwise(local), F.repeat(F.lit("a"), more))
    email = F.concat(_scrambled(long, stream, 16), F.lit("@"), _scrambled(inner, stream, 128), F.lit(".example.com"))
    names = F.split(core, " ")
    script = F.when(core.rlike(r"\p{IsCyrillic}"), "Cyrillic").when(core.rlike(r"\p{IsGreek}"), "Greek").otherwise("Latin")
    of = lambda lists: F.element_at(F.create_map(*(x for k, v in lists.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), script)
    given, syllables = F.when(kind == "woman", of(WOMEN)).otherwise(of(MEN)), of(SYLLABLES)
    # a surname depends on the surname alone, so a full name and its surname stay together
    family = _let(_stream(key, F.lit("family"), F.element_at(names, -1), F.lit(0), F.lit(8)), lambda f: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.get(syllables, F.get(f, i) % 16)), ""))
    firsts = F.transform(F.slice(names, 1, F.greatest(F.lit(0), F.size(names) - 1)), lambda n: F.get(given, F.get(_stream(key, F.lit("given"), n, salt, F.lit(1)), 0) % 8))
    # where a salt is drawn the surname grows, for given names are few
    longer = F.when(salt > 0, F.array_join(F.transform(F.sequence(F.lit(0), 1 + more), lambda i: F.get(syllables, F.get(stream, i) % 16)), "")).otherwise(F.lit(""))
    name = F.array_join(F.concat(firsts, F.array(F.initcap(F.concat(family, longer)))), " ")
    # the length of a country code by its first digits, as the numbering plan has it
    code = F.when(core.rlike("^[17]"), 1).when(core.rlike("^(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), 2).otherwise(3)
    prefix = F.when(kind == "key", 4).when(kind == "phone", code).when((kind == "local") & core.startswith("0"), 1).otherwise(0)
    kept = F.concat(F.substring(core, F.lit(1), prefix), F.substring(scrambled, prefix + 1, F.length(core)))
    return F.when(kind == "email", email).when(kind == "ip", octets).when(kind == "card", card).when(kind == "iban", iban).when(kind.isin("woman", "man"), name).otherwise(kept)


def _threaded(value: Column, core: Column) -> Column:
    """The characters of a core in the places of value's letters and digits; what a grown core has beyond them, behind."""
    chars = F.split(core, "")
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))
    step = lambda a, c: F.when(c.rlike("[A-Za-z0-9]"), F.struct(F.concat(a["s"], F.coalesce(F.get(chars, a["k"]), c)).alias("s"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k")))
    return F.aggregate(F.split(value, ""), start, step, lambda a: F.concat(a["s"], F.substring(core, a["k"] + 1, F.length(core))))


def replacements(found: Column, salts: Column | None, key: str) -> Column:
    """What stands for each mention; salts: a map from kind|core to a salt. Step by step, so that each part is computed once."""
    keep = lambda e, *names: [e[n].alias(n) for n in names]
    salt = lambda e: F.lit(0) if salts is None else F.coalesce(F.try_element_at(salts, F.concat_ws("|", e["kind"], e["core"])), F.lit(0))
    out = F.transform(found, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    out = F.transform(out, lambda e: F.struct(*keep(e, "m", "kind"), value_of(e["m"], e["kind"]).alias("value"), core_of(e["m"], e["kind"]).alias("core")))
    out = F.transform(out, lambda e: F.struct(*keep(e, "m", "kind", "value"), surrogate(e["kind"], e["core"], salt(e), key).alias("new")))

    def text(e: Column) -> Column:
        kind, value, new = e["kind"], e["value"], e["new"]
        upper = (value == F.upper(value)) & (value != F.lower(value))
        put = F.when(kind.isin("email", "ip", "ip6"), F.when(upper, F.upper(new)).otherwise(new)).when(kind.isin("woman", "man"), new).otherwise(_threaded(value, new))
        return F.concat(F.substring(e["m"], F.lit(1), F.length(e["m"]) - F.length(value)), put)

    return F.transform(out, text)


def replaced(text: Column, found: Column, salts: Column | None, key: str) -> Column:
    """The text with each mention replaced: the pieces between the mentions, and the replacements."""
    pieces = F.split(text, ANY, -1)
    news = F.concat(replacements(found, salts, key), F.array(F.lit("")))
    return F.array_join(F.zip_with(pieces, news, lambda a, b: F.concat(a, b)), "")


def salted(docs: DataFrame, key: str) -> DataFrame:
    """(kind, core, salt) of the entities that must not use salt 0."""
    seen = docs.select(F.explode(F.array_distinct(mentions(F.col("text")))).alias("m"))
    # a mention and its count first, so that kinds and cores are found once per spelling
    seen = seen.groupBy("m").agg(F.count("*").alias("n")).withColumn("kind", kind_of(F.col("m")))
    entities = C.stage(seen.withColumn("core", core_of(F.col("m"), F.col("kind"))).groupBy("kind", "core").agg(F.sum("n").alias("n")), "entities")
    pending, settled, salt = entities.withColumn("salt", F.lit(0)), None, 0
    occurs = entities.select(looks_of(F.col("kind")).alias("looks"), F.col("core").alias("ident")).distinct().withColumn("occurs", F.lit(True))
    while True:
        drawn = pending.withColumn("new", surrogate(F.col("kind"), F.col("core"), F.col("salt"), key))
        # a name's surrogate has capitals; compared is what would be read back from it
        drawn = C.stage(drawn.withColumn("ident", F.when(F.col("kind").isin("woman", "man"), F.lower("new")).otherwise(F.col("new"))).withColumn("looks", looks_of(F.col("kind"))), "drawn")
        best = drawn.groupBy("kind", "ident").agg(F.max(F.struct("n", "core"))["core"].alias("best"))
        judged = drawn.join(best, ["kind", "ident"]).join(occurs, ["looks", "ident"], "left")
        if settled is not None:
            judged = judged.join(settled.select("kind", "ident", F.lit(True).alias("taken")), ["kind", "ident"], "left")
        else:
            judged = judged.withColumn("taken", F.lit(None).cast("boolean"))
        judged = C.stage(judged.withColumn("ok", (F.col("core") == F.col("best")) & F.col("occurs").isNull() & F.col("taken").isNull()), "judged")
        good = judged.filter("ok").select("kind", "core", "ident", "salt")
        settled = good if settled is None else settled.unionByName(good)
        bad = judged.filter(~F.col("ok"))
        salt += 1
        if bad.isEmpty():
            return settled.filter("salt > 0").select("kind", "core", "salt")
        pending = bad.select("kind", "core", "n", F.lit(salt).alias("salt"))


def with_surrogates(docs: DataFrame, key: str, broadcast_rows: int = 100_000) -> DataFrame:
    """docs with text replaced, and n_entities (long). key: what makes surrogates unguessable; the same key, the same surrogates."""
    if not key:
        raise ValueError("surrogates need a key")
    own = "_pii"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    with C.scratch(docs.sparkSession):
        salts = C.stage(salted(docs, key), "salts", keep=True)
    found = docs.withColumn(own, mentions(F.col("text")))
    salt_map = None
    if not salts.isEmpty():
        # the salts of a text, by a digest of the text: the same in any order of rows
        named = salts.select(F.concat_ws("|", "kind", "core").alias("id"), "salt")
        ids = F.array_distinct(F.transform(own, lambda m: F.concat_ws("|", kind_of(m), core_of(m, kind_of(m)))))
        held = found.filter(F.size(own) > 0).select(F.md5("text").alias("digest"), F.explode(ids).alias("id"))
        few = salts.count() <= broadcast_rows
        maps = held.join(F.broadcast(named) if few else named, "id").groupBy("digest").agg(F.map_from_entries(F.collect_set(F.struct("id", "salt"))).alias("salts"))
        maps = C.stage(maps, "salt-maps").withColumnsRenamed({"digest": f"{own}digest", "salts": f"{own}salts"})
        found = found.withColumn(f"{own}digest", F.md5("text"))
        if maps.count() <= broadcast_rows:
            found = found.join(F.broadcast(maps), f"{own}digest", "left")
        else:  # copies of one text are dealt over many tasks
            found = found.withColumn(f"{own}part", F.pmod(F.xxhash64(F.lit(3), *(F.col(f"`{c}`") for c in docs.columns if c != "text")), F.lit(32)))
            wide = maps.withColumn(f"{own}part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))))
            found = found.join(wide, [f"{own}digest", f"{own}part"], "left")
        salt_map = F.coalesce(f"{own}salts", F.create_map().cast("map<string,int>"))
    text = F.when(F.size(own) > 0, replaced(F.col("text"), F.col(own), salt_map, key)).otherwise(F.col("text"))
    return found.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns), F.coalesce(F.size(own), F.lit(0)).cast("long").alias("n_entities"))


def _key(spark: SparkSession) -> str:
    return spark.conf.get("spark.gridscribe.pii.key", TRIAL_KEY)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(C.pick(C.table(spark, sf_dir, "documents"), doc_id="long", text="string"), _key(spark))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, entities replaced; n_chars is counted anew. An empty input gives no rows, a null text stays null."""
    own, back = C.apart(docs, "text")
    out = back(with_surrogates(own, _key(spark)))
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.select(*(F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


QUERIES = {"op3_pii": op3_pii}
