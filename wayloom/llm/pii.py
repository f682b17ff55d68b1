"""Personal data: detected entities get keyed surrogates of the same kind and form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm.shared import stored

KEY = "surrogate-key-1"

#: Titles, and given names by gender and script. A name is only looked for after a title or a listed given name.
TITLES = {"m": "Mr Mister Herr Monsieur Señor Sr Signor господин Κύριος", "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Srta Signora госпожа Κυρία", "": "Dr Prof"}
GIVEN = {
    ("m", "latin"): "James Robert John Michael David William Richard Joseph Thomas Charles Peter Hans Jürgen Wolfgang Klaus Pierre Jacques François Michel Carlos José Miguel Pablo Luis",
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Ursula Monika Petra Sabine Brigitte Marie Camille Sophie Juliette María Carmen Lucía Isabel Pilar",
    ("m", "cyrillic"): "Александр Дмитрий Сергей Иван Михаил Николай Павел Олег",
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана",
    ("m", "greek"): "Γιώργος Νίκος Κώστας Δημήτρης Παναγιώτης",
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία",
}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
SYLLABLES = {
    "latin": "bar ben cal dan del far gan hol ker lam len mar mel nor pel ran ros sal tan tor vel wen win zan",
    "cyrillic": "бар вел гор дан зор кам лев мар нев пав рос сав тим чер",
    "greek": "βαρ γαλ δαν καρ λεν μαρ νικ παλ ρον σαν ταρ φιλ",
}

_L, _B, _E = r"[\p{L}\p{N}_]", r"(?<![\p{L}\p{N}_.])", r"(?![\p{L}\p{N}_]|\.\p{N})"
_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_TITLE = "|".join(t for v in TITLES.values() for t in v.split())
_GIVEN_ALL = "|".join(n for v in GIVEN.values() for n in v.split())
SECRET = r"(?<![\p{L}\p{N}_])(?i:token|secret|api[_-]?key|password|passwd)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?[A-Za-z0-9_+/-]{16,}={0,2}"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.){1,127}\p{L}{2,}"  # a host name has at most 127 labels; an open count would recurse for each
IP = _B + r"(?:\d{1,3}\.){3}\d{1,3}" + _E
CARD = r"(?<![\p{L}\p{N}_.-])(?:\d{4}(?<gap>[ -])\d{4}\k<gap>\d{4}\k<gap>\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\p{L}\p{N}_]|[.-]\d)"
PHONE = (
    r"(?<![\p{L}\p{N}_.+])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}([.-])\d{3}\2\d{4}"
    r"|\+[2-9]\d{0,2}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){2,3})" + _E
)
SSN = _B + r"\d{3}-\d{2}-\d{4}(?!-?\d|[\p{L}_])"
PERSON = rf"(?<![\p{{L}}\p{{N}}_])(?:(?:{_TITLE})\.? {_NAME}(?: {_NAME})?|(?:{_GIVEN_ALL})(?: \p{{Lu}}\.)? {_NAME})(?![\p{{L}}\p{{N}}_])"
ENTITY = "|".join((SECRET, EMAIL, IP, CARD, PHONE, SSN, PERSON))


def _full(x: str, pattern: str) -> str:
    return f"{x} rlike r'^(?:{pattern})$'"


def _luhn(digits: str) -> str:
    """Whether the check digit of a digit string is right."""
    value = f"cast(substr({digits}, -i, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + if(i % 2 = 1, {value}, {value} * 2 - if({value} > 4, 9, 0))) % 10 = 0"


def kind_of(m: str) -> str:
    """SQL for the kind of a match; null for numbers that only look like a card or an address."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    octets = f"forall(split({m}, '[.]'), o -> cast(o as int) <= 255)"
    return f"""case when {m} like '%@%' then 'email' when {m} rlike r'^(?i:token|secret|api|passw)' and {m} rlike '[=:]' then 'secret'
      when {m} rlike r'^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$' then if({octets}, 'ip', null)
      when {m} rlike r'^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then 'ssn'
      when {m} rlike r'^[0-9 -]+$' and length({digits}) >= 13 then if({_luhn(digits)}, 'card', null)
      when {m} rlike r'^[(+0-9]' then 'phone' else 'person' end"""


def _script(x: str) -> str:
    return f"case when {x} rlike r'\\p{{IsCyrillic}}' then 'cyrillic' when {x} rlike r'\\p{{IsGreek}}' then 'greek' else 'latin' end"


def _listed(words: str) -> str:
    return ", ".join(f"'{w}'" for w in words.split())


def _parts(m: str, kind: str) -> str:
    """SQL for the pieces of a match: (text, kind, canonical); pieces without a kind stay as they are."""
    piece = "named_struct('text', {}, 'kind', {}, 'canonical', {})"
    keep = lambda x: piece.format(x, "cast(null as string)", "cast(null as string)")
    email = f"array({piece.format(f"substring_index({m}, '@', 1)", "'mailbox'", f'lower({m})')}, {keep("'@'")}, {piece.format(f"substring_index({m}, '@', -1)", "'domain'", f"lower(substring_index({m}, '@', -1))")})"
    value = f"regexp_extract({m}, r'([A-Za-z0-9_+/-]+={{0,2}})$', 1)"
    secret = f"array({keep(f'substr({m}, 1, length({m}) - length({value}))')}, {piece.format(value, "'secret'", value)})"
    number = f"array({piece.format(m, kind, f"regexp_replace({m}, '[^0-9+]', '')")})"
    given = {g: _listed(" ".join(v for (k, _), v in GIVEN.items() if k == g)) for g in "mf"}
    title = {g: "|".join(TITLES[g].split()) for g in "mf"}
    gender = " ".join(f"when w in ({given[g]}) then 'given_{g}'" for g in "mf")
    first = " ".join(f"when i = 1 and size(ws) > 2 and ws[0] rlike r'^(?:{title[g]})\\.?$' then 'given_{g}'" for g in "mf")
    label = f"case {gender} {first} else 'surname' end"
    whole = f"array_join(array(concat(if(i > 0, ' ', ''), w)), '')"
    words = f"""(transform(array(split({m}, ' ')), ws -> flatten(transform(ws, (w, i) -> if(w rlike r'^(?:{_TITLE})\\.?$' or w rlike r'^\\p{{Lu}}\\.$',
      array({keep(whole)}), array({keep("if(i > 0, ' ', '')")}, {piece.format("w", f"concat({label}, '_', {_script('w')})", "lower(w)")}))))))[0]"""
    return f"case {kind} when 'email' then {email} when 'secret' then {secret} when 'person' then {words} when 'ip' then array({piece.format(m, kind, m)}) else {number} end"


def surrogate(key: str) -> Column:
    """A surrogate for columns (kind, canonical, attempt): drawn from a keyed hash, of the kind's form.

    Mailboxes, host names and secrets keep the class of every character; numbers their length, cards also the first digit and a
    right check digit, phones the country code; given names come from the list of the same gender and script, surnames
    from syllables of the script. A later attempt draws again, and from the fourth on adds to the length where it may.
    """
    n = lambda i: f"cast(conv(substr(h, 2 * (({i}) % 128) + 1, 2), 16, 10) as int)"
    letter = lambda script, i: f"substr('{ALPHABETS[script]}', {n(i)} % {len(ALPHABETS[script])} + 1, 1)"
    char = f"""case when c rlike '[0-9]' then cast({n('i')} % 10 as string) when c rlike '[A-Z]' then upper({letter('latin', 'i')})
      when c rlike r'\\p{{IsCyrillic}}' then {letter('cyrillic', 'i')} when c rlike r'\\p{{IsGreek}}' then {letter('greek', 'i')} when c rlike r'\\p{{L}}' then {letter('latin', 'i')} else c end"""
    chars = lambda x: f"array_join(transform(split({x}, ''), (c, i) -> {char}), '')"
    more = f"array_join(transform(slice(sequence(0, attempt div 4), 1, attempt div 4), i -> {letter('latin', '100 + i')}), '')"
    hexes = f"array_join(transform(split(canonical, ''), (c, i) -> substr('0123456789abcdef', {n('i')} % 16 + 1, 1)), '')"
    digits = lambda count, start: f"array_join(transform(slice(sequence(0, {count}), 1, {count}), i -> cast({n(f'i + {start}')} % 10 as string)), '')"
    body = f"concat(substr(canonical, 1, 1), {digits('(length(canonical) - 2)', 0)})"
    doubled = "cast(substr(b, -i, 1) as int) * if(i % 2 = 1, 2, 1)"
    card = f"(transform(array({body}), b -> concat(b, cast((10 - aggregate(sequence(1, length(b)), 0, (s, i) -> s + {doubled} - if({doubled} > 9, 9, 0)) % 10) % 10 as string))))[0]"
    code = "case when canonical like '+1%' then 2 when canonical like '+%' then 3 else 0 end"
    phone = f"concat(substr(canonical, 1, {code}), cast({n('0')} % 8 + 2 as string), {digits(f'(length(canonical) - {code} - 1)', 1)})"
    ip = f"concat_ws('.', {n('0')} % 223 + 1, {n('1')}, {n('2')}, {n('3')} % 254 + 1)"
    cases = [
        ("kind = 'mailbox'", f"concat({chars("substring_index(canonical, '@', 1)")}, {more})"),
        ("kind = 'domain'", f"concat({chars("substr(canonical, 1, length(canonical) - length(substring_index(canonical, '.', -1)) - 1)")}, {more}, '.', substring_index(canonical, '.', -1))"),
        ("kind = 'secret'", f"if(canonical rlike '^[0-9a-f]+$', {hexes}, {chars('canonical')})"),
        ("kind = 'card'", card), ("kind = 'phone'", phone), ("kind = 'ip'", ip), ("kind = 'ssn'", digits("length(canonical)", 0)),
    ]
    for (g, script), names in GIVEN.items():
        pick = lambda i, w=names.split(): f"element_at(array({_listed(' '.join(w))}), {n(i)} % {len(w)} + 1)"
        syllables = SYLLABLES[script].split()
        tail = f"array_join(transform(slice(sequence(0, attempt), 1, greatest(0, attempt - 3)), i -> element_at(array({_listed(' '.join(syllables))}), {n('20 + i')} % {len(syllables)} + 1)), '')"
        cases.append((f"kind = 'given_{g}_{script}'", f"concat({pick('0')}, if(attempt > 0, concat('-', {pick('1')}), ''), {tail})"))
    for script, all_syllables in SYLLABLES.items():
        s = all_syllables.split()
        cases.append((f"kind = 'surname_{script}'", f"initcap(array_join(transform(sequence(0, 2 + attempt div 4), i -> element_at(array({_listed(all_syllables)}), {n('i')} % {len(s)} + 1)), ''))"))
    hashed = "concat(sha2(concat_ws('|', '{0}', kind, canonical, attempt, 'a'), 512), sha2(concat_ws('|', '{0}', kind, canonical, attempt, 'b'), 512))".format(key.replace("'", ""))
    return F.expr(f"(transform(array({hashed}), h -> case {' '.join(f'when {c} then {v}' for c, v in cases)} end))[0]")


def surrogate_table(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canonical, surrogate) for distinct (kind, canonical): no two of a kind share a surrogate, and none is a known entity.

    Of entities that draw the same surrogate the smallest keeps it; the others, and those whose draw is itself an entity of
    the corpus, draw again until none is left.
    """
    known = entities.select("kind", F.lower("canonical").alias("s")).distinct()
    done: DataFrame | None = None
    left = entities.withColumn("attempt", F.lit(0))
    while True:
        drawn = stored(left.withColumn("surrogate", surrogate(key)).withColumn("s", F.lower("surrogate")), "pii-drawn")
        first = drawn.groupBy("kind", "s").agg(F.min("canonical").alias("canonical"))
        good = drawn.join(first, ["kind", "s", "canonical"], "left_semi").join(known, ["kind", "s"], "left_anti")
        if done is not None:
            good = good.join(done.select("kind", F.lower("surrogate").alias("s")), ["kind", "s"], "left_anti")
        good = stored(good.select("kind", "canonical", "surrogate"), "pii-surrogates")
        done = good if done is None else done.unionByName(good)
        left = drawn.join(good, ["kind", "canonical"], "left_anti").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        if left.isEmpty():
            return done


_RENDERED = """case when kind is null then text when kind in ('card', 'phone', 'ssn')
    then aggregate(split(text, ''), named_struct('t', '', 'd', regexp_replace(surrogate, '[^0-9]', '')),
      (a, c) -> named_struct('t', concat(a.t, if(c rlike '[0-9]', substr(a.d, 1, 1), c)), 'd', if(c rlike '[0-9]', substr(a.d, 2), a.d)), a -> a.t)
    when kind = 'secret' or kind = 'ip' then surrogate
    when text = upper(text) and text <> lower(text) and length(text) > 1 then upper(surrogate)
    when kind in ('mailbox', 'domain') then surrogate else surrogate end"""


def replace_entities(docs: DataFrame, key: str = KEY, columns: list[str] | None = None) -> DataFrame:
    """Every row of docs (doc_id, text): row (a struct of `columns`, by default doc_id alone), n_entities, kinds, text.

    Kinds: email, ip, phone, ssn, card (13 to 19 digits with a right check digit), secret (a long value after token, password
    and the like) and person (names after a title or a listed given name). Each gets a surrogate from a keyed hash (see
    `surrogate`): one entity, however written (case, spaces and signs in numbers; a surname alone or with a given name), has one
    surrogate in all documents, and two entities never share one (see `surrogate_table`). Numbers that only look like a card or
    address stay. kinds lists the kinds found, sorted. A null text stays null with no entities; other texts are read whole.
    Repeated rows each get their own, equal result.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in columns or ["doc_id"]]).alias("row")
    has = F.coalesce(F.col("text").rlike(ENTITY), F.lit(False))
    found = docs.filter(has).select(
        carried, F.monotonically_increasing_id().alias("at"), F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)).alias("matches"), F.split("text", ENTITY, -1).alias("between")
    )
    found = stored(found, "pii-found")
    spans = found.select("at", F.posexplode("matches").alias("i", "m")).withColumn("kind", F.expr(kind_of("m")))
    parts = stored(
        spans.filter("kind is not null").select("at", "i", F.col("kind").alias("entity"), F.posexplode(F.expr(_parts("m", "kind"))).alias("j", "p")).select("at", "i", "entity", "j", "p.*"), "pii-parts"
    )
    entities = parts.filter("kind is not null").select("kind", "canonical").distinct()
    table = surrogate_table(entities, key)
    named = parts.filter("kind is not null").join(table, ["kind", "canonical"]).select("at", "i", "entity", "j", F.expr(_RENDERED).alias("t"))
    plain = parts.filter("kind is null").select("at", "i", "entity", "j", F.col("text").alias("t"))
    shown = (
        named.unionByName(plain).groupBy("at", "i", "entity").agg(F.array_sort(F.collect_list(F.struct("j", "t"))).alias("p"))
        .select("at", "i", "entity", F.array_join(F.col("p.t"), "").alias("t"))
        .groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("i", "t"))).alias("new"), F.count("*").alias("n_entities"), F.array_sort(F.collect_set("entity")).alias("kinds"))
    )
    joined = F.expr("concat(between[0], array_join(transform(matches, (m, i) -> concat(coalesce(new[i], m), between[i + 1])), ''))")
    none = F.array().cast("array<string>")
    changed = found.join(shown, "at", "left").select("row", F.coalesce("n_entities", F.lit(0)).cast("long").alias("n_entities"), F.coalesce("kinds", none).alias("kinds"), joined.alias("text"))
    same = docs.filter(~has).select(carried, F.lit(0).cast("long").alias("n_entities"), none.alias("kinds"), F.col("text").cast("string").alias("text"))
    return changed.unionByName(same)
