"""PII surrogates, in DataFrame and SQL functions only.

Mentions are found by one alternation of patterns.  Card numbers must pass Luhn's check and
account numbers (IBAN) the remainder 97, else they are left as they are.  Names are found
after a title; where a text has such a name, its further mentions in that text without a
title (the whole name, or the family name alone) are mentions too.

A mention is made of entities: an address of its local part and its domain, a name of given
names and family names; other mentions are one entity in a canonical form (phone numbers by
their last ten digits, other numbers without separators).  Each entity of the corpus gets
one surrogate, so all mentions of a person, with whichever title or none, agree, and all
addresses of a domain keep one domain.  A surrogate is derived from a keyed digest of (kind,
entity, attempt) and keeps what the entity is like: digits for digits, letters for letters,
an address's ending, a card's issuer digit and check digit, an account's country and check
digits, networks' octets below 255 and groups of hex digits, a name's script, capitals, and
gender: of given names by the titles that they have anywhere in the corpus (none, or both:
a neutral name), of Cyrillic family names by their ending.

Collision checks: surrogates that two entities share, or that occur as an entity in the
corpus or among those accepted, are derived anew with the next attempt, until none is
left; so different entities stay different.  Where all addresses or names of a shape can be
taken, attempts after ``KEEP`` make them longer, so one that is free is always found.
Numbers keep their length: if after ``ROUNDS`` some have no surrogate (nearly all numbers of
that form would have to occur), an error says so, and nothing is cut from a text.

Only rows with a mention are joined, by a hash of the row.  Mentions get their replacements
from a table with one row for each different mention; the commonest are broadcast (a bounded
number, see ``join_hot``), so an address in very many texts isn't one task's.

Null texts stay null; empty texts and texts without mentions stay as they are.  Texts are
searched whole, however long.  Repeated rows get the same replacement.  Other columns stay,
but for one called ``pii``, which is replaced.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeolith.llm.common import join_hot, settle

# Patterns of mentions (Java syntax) and titles by gender.
EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
HEX = "[0-9A-Fa-f]{1,4}"
IP4 = rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?[0-9])"
IP6 = rf"(?<![\w:.])(?=[A-Fa-f:]*[0-9])(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{1,6}}:(?:{HEX}(?::{HEX}){{0,5}})?|::{HEX}(?::{HEX}){{0,6}})(?![\w:])"
IP = f"{IP4}|{IP6}"
CARD = r"(?<![0-9])(?:[2-6][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,5}(?![0-9])"
MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Г-н", "господин", "κ")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Señorita", "Madame", "Mme", "Mademoiselle", "Г-жа", "госпожа", "κα")
NEUTRAL = ("Dr", "Prof")
_TITLES = "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True))
NAME = rf"(?<!\p{{L}})(?:(?:{_TITLES})\.? )+\p{{Lu}}[\p{{L}}'’]+(?:[ -]\p{{Lu}}[\p{{L}}'’]+){{0,2}}"
TITLED = rf"^((?:(?:{_TITLES})\.? )+)"
MENTION = "|".join((EMAIL, IP, SSN, IBAN, CARD, PHONE, NAME))

#: What has digits.
NUMBERS = "|".join((IP, SSN, IBAN, CARD, PHONE))

#: Given names by script and gender, and syllables of family names by script.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl Denis Emil Felix Georg Hugo Ivan Jonas Karl Leon Marc Noel Otto Paul Rene Simon Theo Victor".split(),
    ("latin", "f"): "Anna Berta Clara Diana Emma Flora Greta Helena Irene Julia Klara Lena Maria Nina Olga Paula Rosa Sofia Tina Vera".split(),
    ("latin", "n"): "Alex Chris Dana Eden Jules Kim Lou Max Noa Robin Sam Sascha Toni Yael Andrea Dominique Morgan Quinn Rowan Sidney".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Денис Егор Иван Кирилл Лев Максим Никита Олег Павел".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Инна Ксения Лидия Мария Нина Ольга".split(),
    ("cyrillic", "n"): "Саша Женя Валя Слава Никита Паша Шура Тоша".split(),
    ("greek", "m"): "Άρης Γιάννης Δήμος Ηλίας Κώστας Λεωνίδας Μάριος Νίκος Πέτρος Σπύρος".split(),
    ("greek", "f"): "Άννα Βασιλική Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Σοφία".split(),
    ("greek", "n"): "Αλέξης Άγγελος Κυριακή Χρύσα Φώτης Ηρώ".split(),
}
SYLLABLES = {
    "latin": "ba ben ber bor da del dor fal fen gar gel hal har kel kor lan len lor mar mel mor nar nel nor pel per ral ren ros sal sen sor tal ten tor val ver vor wel wen".split(),
    "cyrillic": "ба бел бор вал вер гор дан дор зар кал кор лан лен мар мел мор нар нов пал пет рад рос сал сен сор тал тор".split(),
    "greek": "βα βελ γαρ δαλ δορ ζερ καλ κορ λαν λεν μαρ μελ μορ ναρ νελ παλ περ ραλ ρος σαλ σεν ταλ τορ".split(),
}
#: Attempts that keep an address's or name's length, and all attempts.
KEEP, ROUNDS = 4, 200
#: The last letters of Cyrillic family names that tell a gender.
ENDINGS = ("ов", "ев", "ин", "ова", "ева", "ина")
TYPES = ("email", "ip", "ssn", "iban", "card", "phone", "name")


def _strings(xs) -> str:
    return "array(" + ", ".join("'" + x.replace("'", "\\'") + "'" for x in xs) + ")"


def has_mention(text: Column) -> Column:
    """Whether MENTION is found; the costly patterns run only where a sign that they need is there."""
    found = (text.contains("@") & text.rlike(EMAIL)) | (text.rlike("[0-9]") & text.rlike(NUMBERS)) | text.rlike(NAME)
    return F.coalesce(found, F.lit(False))


def known_names(titled: Column) -> Column:
    """What else stands for the names ``titled`` (an array) in a text, longest first, as a pattern."""
    bare = F.transform(titled, lambda m: F.regexp_replace(m, TITLED, ""))
    own = F.flatten(F.transform(bare, lambda x: F.array(x, F.substring_index(x, " ", -1), F.initcap(x), F.upper(x), F.initcap(F.substring_index(x, " ", -1)), F.upper(F.substring_index(x, " ", -1)))))
    own = F.array_sort(F.transform(F.array_distinct(own), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    return F.concat(F.lit(MENTION + r"|(?<!\p{L})(?:"), F.array_join(F.transform(own, lambda x: x["x"]), "|"), F.lit(r")(?!\p{L})"))


def _luhn(digits: str) -> str:
    """The Luhn sum modulo 10."""
    return f"""pmod(aggregate(transform(split(reverse({digits}), ''), (c, i) ->
        case when i % 2 = 1 then case when cast(c as int) > 4 then 2 * cast(c as int) - 9 else 2 * cast(c as int) end else cast(c as int) end), 0, (a, x) -> a + x), 10)"""


def _mod97(account: str) -> str:
    """The remainder of an account number, read with its first four signs at the end."""
    return f"""aggregate(split(concat(substring({account}, 5), left({account}, 4)), ''), 0, (a, c) ->
        case when c = '' then a when c between '0' and '9' then (10 * a + cast(c as int)) % 97 else (100 * a + ascii(c) - 55) % 97 end)"""


def with_parts(mentions: DataFrame) -> DataFrame:
    """``mentions`` (with mention) with kind (null: none after all), gender (of a title: m, f or n)
    and parts, an array of (kind, entity)."""
    whole = lambda p: F.col("mention").rlike(rf"^(?:{p})$")
    m, plain = F.col("mention"), F.regexp_replace("mention", "[^0-9A-Za-z]", "")
    kind = F.when(m.contains("@"), "email").when(whole(IP), "ip").when(whole(SSN), "ssn")
    kind = kind.when(whole(IBAN), F.when(F.expr(_mod97("plain")) == 1, "iban")).when(whole(CARD), F.when(F.length("plain").between(13, 19) & (F.expr(_luhn("plain")) == 0), "card")).when(whole(PHONE), "phone").otherwise("name")
    d = mentions.withColumn("plain", plain).withColumn("kind", kind)
    title = F.regexp_extract("mention", TITLED, 1)
    says = lambda xs: title.rlike(rf"(?:^| )(?:{'|'.join(xs)})\.? ")
    gender = F.when(F.col("kind") == "name", F.when(says(MALE) & ~says(FEMALE), "m").when(says(FEMALE) & ~says(MALE), "f").otherwise("n"))
    d = d.withColumn("bare", F.when(F.col("kind") == "name", F.regexp_replace("mention", TITLED, ""))).withColumn("gender", gender)
    return d.withColumn("parts", F.expr("""case kind
        when 'email' then array(struct('local' as kind, lower(mention) as entity), struct('domain' as kind, lower(substring_index(mention, '@', -1)) as entity))
        when 'name' then concat(
            transform(filter(split(substring(bare, 1, length(bare) - length(substring_index(bare, ' ', -1))), '[ -]'), x -> x <> ''), x -> struct('given' as kind, initcap(x) as entity)),
            transform(split(substring_index(bare, ' ', -1), '-'), x -> struct('family' as kind, initcap(x) as entity)))
        when 'phone' then array(struct(kind, right(plain, 10) as entity))
        when 'ip' then array(struct(kind, lower(mention) as entity))
        else case when kind is not null then array(struct(kind, plain as entity)) end end""")).drop("plain")  # fmt: skip


#: A number below ``of`` from place ``i`` of the 128 hex digits ``d``.
def _draw(d: str, i: str, of: str) -> str:
    return f"pmod(cast(conv(substring({d}, 1 + 3 * pmod({i}, 41), 4), 16, 10) as bigint) + 7 * ({i}), {of})"


def _letters(value: str, digest: str) -> str:
    """Each digit and ASCII letter replaced by one of its kind."""
    return f"""array_join(transform(split({value}, ''), (c, i) ->
        case when c between '0' and '9' then cast({_draw(digest, 'i', '10')} as string)
             when c between 'a' and 'z' then chr(97 + {_draw(digest, 'i', '26')})
             when c between 'A' and 'Z' then chr(65 + {_draw(digest, 'i', '26')})
             else c end), '')"""


def surrogate(key: str) -> list[tuple[str, str]]:
    """Columns, to be added in turn to (kind, entity, gender, attempt), of which the last is ``surrogate``."""
    k = key.replace("\\", "\\\\").replace("'", "\\'")
    script = r"case when entity rlike '\\p{IsCyrillic}' then 'cyrillic' when entity rlike '\\p{IsGreek}' then 'greek' else 'latin' end"
    given = "case " + " ".join(f"when script = '{s}' and gender = '{g}' then {_strings(names)}" for (s, g), names in GIVEN.items()) + " end"
    parts = "case " + " ".join(f"when script = '{s}' then {_strings(x)}" for s, x in SYLLABLES.items()) + " end"
    # one name up to KEEP attempts, then more, joined
    names = f"array_join(transform(sequence(1, 1 + greatest(0, attempt - {KEEP} + 4) div 4), j -> get(names, cast({_draw('d', '7 * j', 'size(names)')} as int))), '-')"
    ending = "case " + " ".join(f"when entity like '%{e}' then '{e[:2] if len(e) == 2 else e}'" for e in sorted(ENDINGS, key=len, reverse=True)) + " else '' end"
    family = f"concat(initcap(array_join(transform(sequence(1, 2 + least(attempt, 3) + greatest(0, attempt - {KEEP})), j -> get(syl, cast({_draw('d', 'j', 'size(syl)')} as int))), '')), case when script = 'cyrillic' then {ending} else '' end)"
    # none up to KEEP attempts, then a letter more each time
    wider = f"array_join(transform(slice(sequence(0, greatest(attempt, {KEEP})), {KEEP} + 1, greatest(0, attempt - {KEEP} + 1)), (x, j) -> chr(97 + {_draw('d', '20 + j', '26')})), '')"
    ip = f"array_join(transform(split(entity, '[.]'), (x, i) -> cast(1 + {_draw('d', 'i', '254')} as string)), '.')"
    hexed = f"array_join(transform(split(entity, ''), (c, i) -> case when c = ':' or c = '' then c else substring('0123456789abcdef', 1 + {_draw('d', 'i', '16')}, 1) end), '')"
    body = _letters("substring(entity, 2, length(entity) - 2)", "d")
    return [
        ("d", f"sha2(concat_ws('\\u0001', '{k}', kind, entity, cast(attempt as string)), 512)"),
        ("script", f"case when kind in ('given', 'family') then {script} end"),
        ("names", f"case when kind = 'given' then {given} end"),
        ("syl", f"case when kind = 'family' then {parts} end"),
        ("body", f"case kind when 'card' then concat(left(entity, 1), {body}) when 'iban' then concat(left(entity, 2), '00', {_letters('substring(entity, 5)', 'd')}) end"),
        (
            "surrogate",
            f"""case kind
            when 'local' then concat({_letters("substring_index(entity, '@', 1)", 'd')}, {wider}, '@', substring_index(entity, '@', -1))
            when 'domain' then concat({_letters("regexp_replace(entity, '[.][^.]+$', '')", 'd')}, {wider}, '.', substring_index(entity, '.', -1))
            when 'ip' then case when entity like '%:%' then {hexed} else {ip} end
            when 'iban' then concat(left(body, 2), lpad(cast(98 - {_mod97('body')} as string), 2, '0'), substring(body, 5))
            when 'card' then concat(body, cast(pmod(10 - {_luhn("concat(body, '0')")}, 10) as string))
            when 'given' then {names}
            when 'family' then {family}
            else {_letters('entity', 'd')} end""",
        ),
    ]


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) for (kind, entity, gender: of titles), distinct or not; all
    surrogates of a kind are different from one another and from all entities."""
    steps = surrogate(key)
    said = lambda g: F.coalesce(F.max(F.col("gender") == g), F.lit(False))
    gender = F.when(said("m") & ~said("f"), "m").when(said("f") & ~said("m"), "f").otherwise("n")
    todo = settle(entities.groupBy("kind", "entity").agg(gender.alias("gender")).withColumn("attempt", F.lit(0)), "entities")
    taken = todo.select("kind", F.col("entity").alias("surrogate"))
    done, rounds = [], 0
    while True:
        made = todo
        for name, expr in steps:
            made = made.withColumn(name, F.expr(expr))
        made = settle(made.select("kind", "entity", "gender", "attempt", "surrogate"), "made")
        first = made.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        good = settle(made.join(first, ["kind", "surrogate", "entity"]).join(taken, ["kind", "surrogate"], "left_anti").select("kind", "entity", "surrogate"), "good")
        done.append(good)
        left = made.join(good.select("kind", "entity"), ["kind", "entity"], "left_anti")
        todo = settle(left.select("kind", "entity", "gender", (F.col("attempt") + 1).alias("attempt")), "left")
        rounds += 1
        if todo.isEmpty():
            break
        if rounds >= ROUNDS:
            kinds = {r.kind: r["count"] for r in todo.groupBy("kind").count().collect()}
            raise RuntimeError(f"no free surrogate after {rounds} attempts for entities of these kinds: {kinds}")
        taken = taken.unionByName(good.select("kind", "surrogate"))
    out = done[0]
    for g in done[1:]:
        out = out.unionByName(g)
    return out


def rendered() -> Column:
    """Of (mention, kind, bare, new: a map from kind:entity to surrogate) the replacement, in the form
    of the mention: its separators and title, its capitals."""
    # the last signs of the mention, as many as the surrogate has, are filled in from the right
    filled = lambda signs, x: f"""reverse(array_join(aggregate(reverse(split(mention, '')), struct(cast(array() as array<string>) as o, 0 as k), (a, c) ->
        case when c rlike '^{signs}$' and a.k < length({x})
             then struct(array_append(a.o, substring({x}, length({x}) - a.k, 1)) as o, a.k + 1 as k)
             else struct(array_append(a.o, c) as o, a.k as k) end).o, ''))"""  # noqa: E731
    one = "map_values(new)[0]"
    # words and separators; those from the family name on are family names
    words = "split(bare, '(?<=[ -])|(?=[ -])')"
    family = "size(split(bare, '(?<=[ -])|(?=[ -])')) - size(split(substring_index(bare, ' ', -1), '(?<=-)|(?=-)'))"
    word = f"""array_join(transform({words}, (w, i) -> case when w in (' ', '-') then w
        else case when length(w) > 1 and w = upper(w) then upper(new[concat(if(i >= {family}, 'family:', 'given:'), initcap(w))]) else new[concat(if(i >= {family}, 'family:', 'given:'), initcap(w))] end end), '')"""
    mail = "concat(substring_index(new[concat('local:', lower(mention))], '@', 1), '@', new[concat('domain:', lower(substring_index(mention, '@', -1)))])"
    cased = lambda x: f"case when mention = upper(mention) and mention <> lower(mention) then upper({x}) else {x} end"
    return F.expr(f"""case kind when 'name' then concat(substring(mention, 1, length(mention) - length(bare)), {word})
        when 'email' then {cased(mail)} when 'ip' then {cased(one)} when 'iban' then {filled('[0-9A-Za-z]', one)}
        when 'ssn' then {filled('[0-9]', one)} when 'card' then {filled('[0-9]', one)} when 'phone' then {filled('[0-9]', one)} else mention end""")


def replace(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with mentions replaced in their texts, and a column ``pii``: the number of
    mentions by type (a map; empty if there are none; a column of that name is replaced)."""
    docs = docs.drop("pii")
    text = docs[text_col]
    has = has_mention(text)
    none = F.expr("cast(map() as map<string,bigint>)")
    clean = docs.where(~has).withColumn("pii", none)
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    row = F.struct(F.xxhash64(*plain), F.xxhash64(F.lit("second"), *plain))
    found = docs.where(has).withColumn("__row", row).withColumn("__t", F.expr(f"regexp_extract_all({_q(text_col)}, {_lit(NAME)}, 0)"))
    pattern = F.when(F.size("__t") > 0, known_names(F.col("__t"))).otherwise(F.lit(MENTION))
    found = found.withColumn("__p", pattern).withColumn("__m", F.expr(f"regexp_extract_all({_q(text_col)}, __p, 0)")).withColumn("__gaps", F.split(F.col(text_col), F.col("__p"), F.lit(-1)))
    hits = settle(found.drop(text_col, "__t", "__p"), "hits")
    each = hits.select("__row", F.explode(F.array_distinct("__m")).alias("mention")).distinct()
    mentions = settle(with_parts(each.groupBy("mention").agg(F.count("*").alias("n"))), "mentions")
    parts = mentions.where("kind is not null").select("mention", "gender", F.explode("parts").alias("p")).select("mention", F.col("p.kind").alias("kind"), F.col("p.entity").alias("entity"), F.when(F.col("p.kind") == "given", F.col("gender")).alias("gender"))
    table = surrogates(parts.drop("mention"), key)
    by_part = parts.join(table, ["kind", "entity"]).groupBy("mention").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "entity"), "surrogate"))).alias("new"))
    ready = mentions.join(by_part, "mention", "left").withColumn("new", rendered()).select("mention", "n", "kind", "new")
    pairs = join_hot(each, settle(ready, "replacements"), "mention", "n")
    maps = pairs.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("mention", F.struct("new", "kind")))).alias("__map"))
    done = hits.join(maps, "__row", "left")
    fail = F.raise_error(F.lit("a mention has no surrogate")).cast("string")
    whole = F.zip_with("__gaps", "__m", lambda g, m: F.concat(g, F.when(m.isNull(), "").otherwise(F.coalesce(F.expr("__map")[m]["new"], fail))))
    kinds = F.filter(F.transform("__m", lambda m: F.expr("__map")[m]["kind"]), lambda k: k.isNotNull())
    counted = F.map_from_entries(F.transform(F.array_distinct(kinds), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)).cast("long"))))
    done = done.withColumn("pii", counted).withColumn(text_col, F.array_join(whole, ""))
    return clean.unionByName(done.select(*docs.columns, "pii"))


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _q(name: str) -> str:
    return f"`{name.replace('`', '``')}`"
