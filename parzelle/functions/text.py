"""Names, addresses and keys in free text, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def replace_each(text: Column, strings: list[str], by: str = "") -> Column:
    return reduce(lambda t, s: F.replace(t, F.lit(s), F.lit(by)), strings, text)


def let(value: Column, f) -> Column:
    """f(value), where the value is computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def transliterate(text: Column) -> Column:
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def parts(text: Column, delimiter: str = ",") -> Column:
    """Trimmed parts."""
    return F.transform(F.split(text, "\\Q" + delimiter + "\\E"), lambda p: F.trim(p))


def drop_parts_with_word(text: Column, word: str) -> Column:
    """Without the comma parts that have the word."""
    return F.array_join(F.filter(parts(text), lambda p: ~F.array_contains(F.split(p, " "), word)), ", ")


def cut_at(text: Column, term: str) -> Column:
    return F.substring_index(text, term, 1)


#: White space that trimmed() takes off.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
# A comma part is a place if it has a number of 4 or 5 digits before a word, or one of 5 digits; it is a
# street if it ends in a house number after a blank, with any suffix free of digits, or if digits end it after a letter.
PLACE = r"(?U)\d{4,5} \w", r"(?U)\d{5}"
STREET = r"(?Ud)^.+\s\d+(\D*[^\d\s])?$", r"(?Ud)[A-Za-z].*\d$"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def matches_any(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.regexp_like(text, F.lit(p)) for p in patterns])


def is_address(part: Column) -> Column:
    """Whether a comma part is a place or a street. What has no digit is neither, so most parts meet one plain test."""
    return F.regexp_like(part, F.lit(r"(?U)\d")) & matches_any(part, (*PLACE, *STREET))


def drop_address_parts(text: Column) -> Column:
    """Without the comma parts that are places or streets."""
    return F.array_join(F.transform(F.filter(F.split(text, ","), lambda p: ~is_address(p)), trimmed), ", ")


def drop_street_word(text: Column, keywords: list[str]) -> Column:
    """Without the last word, wherever it occurs, if it has a street keyword."""
    last = F.element_at(F.split(text, " "), -1)
    return F.when(has_any(last, keywords), F.replace(text, last, F.lit(""))).otherwise(text)


def drop_last_part(text: Column, delimiter: str, keywords: list[str]) -> Column:
    """Without the last part if it has a keyword."""
    split = F.split(text, "\\Q" + delimiter + "\\E")
    n = F.size(split)
    return F.when((n > 1) & has_any(F.element_at(split, -1), keywords), F.array_join(F.slice(split, F.lit(1), n - 1), delimiter)).otherwise(text)


def drop_word_and_next(text: Column, terms: str | list[str], words: int = 2) -> Column:
    """For each term, without the phrase made of its first occurrence as a word of the whole text and what follows there, so many words in all; every occurrence of the phrase goes."""
    split = F.split(text, " ")
    for term in [terms] if isinstance(terms, str) else terms:
        at = F.array_position(split, term)
        phrase = F.array_join(F.slice(split, F.greatest(at, F.lit(1)).cast("int"), F.lit(words)), " ")
        text = F.when(at > 0, F.trim(F.replace(text, phrase, F.lit("")))).otherwise(F.trim(text))
    return text


def has_any(text: Column, terms: list[str]) -> Column:
    """One of the terms is part of the text."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])


def has_word(text: Column, terms: list[str]) -> Column:
    """One of the terms is a whole word, between spaces or commas."""
    padded = F.concat(F.lit(" "), F.replace(text, F.lit(","), F.lit(" ")), F.lit(" "))
    return has_any(padded, [f" {t} " for t in terms])


def birth_date(text: Column) -> Column:
    """From the first * to the next comma; null without a *."""
    return F.when(F.contains(text, F.lit("*")), F.substring_index(F.get(F.split(text, "[*]"), F.lit(1)), ",", 1))


def _first_found(text: Column, of) -> Column:
    """Of the comma parts, in order, the first for which `of` isn't null; empty without one."""
    return F.coalesce(F.get(F.filter(F.transform(F.split(text, ","), of), lambda x: x.isNotNull()), F.lit(0)), F.lit(""))


def postcode(text: Column) -> Column:
    """Of the first comma part that has one: five digits before a word, else four digits before a word, else five digits; empty without one."""
    def of(part: Column) -> Column:
        digits = lambda n: F.regexp_extract(part, rf"(?U)(\d{{{n}}})", 1)
        has = lambda p: F.regexp_like(part, F.lit(p))
        return F.when(has(r"(?U)\d{5} \w"), digits(5)).when(has(r"(?U)\d{4} \w"), digits(4)).when(has(r"(?U)\d{5}"), digits(5))

    return _first_found(text, of)


def street(text: Column) -> Column:
    """First comma part, or line, that ends in a house number, with or without a small letter from a to f; empty without one."""
    ends = lambda p: F.when(F.regexp_like(p, F.lit(r"(?Ud)\d( ?[a-f])?$")), p)
    return trimmed(_first_found(F.replace(text, F.lit("\n"), F.lit(",")), ends))


def city(text: Column) -> Column:
    """What is no digit in the first comma part that has a postcode before a word; empty without one."""
    of = lambda p: F.when(F.regexp_like(p, F.lit(r"(?U)\d{4} \w")), F.array_join(F.regexp_extract_all(p, F.lit(r"(?U)(\D{1,100})"), F.lit(1)), " "))
    return trimmed(_first_found(text, of))


def completeness(has_street: Column, has_city: Column, has_postcode: Column) -> Column:
    """0 to 7: 1 for a street, 2 for a city, 4 for a postcode."""
    bit = lambda c, n: F.when(F.length(c) > 0, n).otherwise(0)
    return bit(has_street, 1) + bit(has_city, 2) + bit(has_postcode, 4)


def rebuilt_address(text: Column) -> Column:
    """One address as 'street number, postcode city', whatever the order of its parts: the number without a leading zero
    and blanks, the city without what follows a slash and without districts (bei, ot); empty without postcode and city."""
    def built(found: Column, place: Column, town: Column) -> Column:
        number = F.regexp_extract(found, r"(?Ud)(\d{1,4}\s?[a-f]?)$", 1)
        with_street = let(number, lambda n: F.concat(trimmed(F.substring(found, F.lit(1), F.length(found) - F.length(n))), F.lit(" "), F.regexp_replace(F.replace(n, F.lit(" "), F.lit("")), "^0", ""), F.lit(", ")))
        return F.when(F.concat(place, town) != "", F.concat(F.when(found != "", with_street).otherwise(""), place, F.lit(" "), town)).otherwise("")

    town = let(F.substring_index(city(text), "/", 1), lambda x: drop_word_and_next(x, ["bei", "ot"]))
    return let(F.struct(street(text).alias("s"), postcode(text).alias("p"), town.alias("t")), lambda x: built(x["s"], x["p"], x["t"]))


def clean_addresses(text: Column, joint: str = "_", unknown: str = "unbekannt") -> Column:
    """Alternatives, each rebuilt from a transliterated text without . and : and with blanks for -; without unknown ones;
    each once, and not if part of a longer one but for blanks; by length, then alphabet."""
    plain = F.replace(replace_each(transliterate(F.lower(text)), [".", ":"]), F.lit("-"), F.lit(" "))
    plain = F.replace(plain, F.lit("strasse"), F.lit("str"))
    known = F.filter(F.transform(F.split(plain, "\\Q" + joint + "\\E"), trimmed), lambda p: ~F.contains(p, F.lit("00000")) & ~F.contains(p, F.lit("unbekannt")))
    each = by_length(F.array_distinct(F.filter(F.transform(known, rebuilt_address), lambda p: p != "")))
    bare = lambda p: F.replace(p, F.lit(" "), F.lit(""))
    kept = let(each, lambda e: F.filter(e, lambda p, i: ~F.exists(F.slice(e, i + 2, F.lit(1 << 30)), lambda q: F.contains(bare(q), bare(p)))))
    return let(kept, lambda k: F.when(F.size(k) > 0, F.array_join(k, joint)).otherwise(unknown))


def owners(text: Column) -> Column:
    """Owners of a free text: an entry to a line; without birth names and address parts, and nothing after the part that
    has the birth date; each once, in order. A last entry that is part of an earlier one is a cut-off repetition and goes.
    A line of nothing but an address is an owner without a name; a blank text is an unknown owner."""
    def one(line: Column) -> Column:
        held = F.filter(F.split(line, ","), lambda p: ~F.array_contains(F.split(p, " "), "geb.") & ~is_address(p))
        cut = lambda h, at: F.when(at > 0, F.slice(h, F.lit(1), F.greatest(at, F.lit(1)).cast("int"))).otherwise(h)
        return let(F.transform(held, trimmed), lambda h: F.array_join(cut(h, F.array_position(F.transform(h, lambda p: F.contains(p, F.lit("*"))), True)), ", "))

    def kept(each: Column) -> Column:
        last, earlier = F.element_at(each, -1), F.slice(each, F.lit(1), F.size(each) - 1)
        gone = F.exists(earlier, lambda o: F.contains(o, last)) & ~F.array_contains(earlier, last)
        return F.array_distinct(F.transform(F.when(gone, earlier).otherwise(each), lambda o: F.replace(trimmed(o), F.lit("  "), F.lit(" "))))

    plain = trimmed(F.regexp_replace(F.lower(F.when(F.length(trimmed(text)) > 0, text).otherwise("unbekannt")), "^,+|,+$", ""))
    return let(F.transform(F.split(plain, "\n"), one), kept)


#: Phrases that a key leaves out, in this order.
FILLERS = ["mit sitz in ", " mit dem sitz in ", " sitz in ", " in ", " ", "-", ",", "&", "+", "`", "\n"]


def merge_key(name: Column) -> Column:
    return replace_each(F.lower(name), FILLERS)


def address_key(text: Column) -> Column:
    """For matching: without white space, punctuation and the ending of street words."""
    return F.replace(replace_each(transliterate(F.lower(text)), [" ", ".", ",", "-", "/"]), F.lit("asse"), F.lit(""))


def given_family(name: Column, place: Column) -> Column:
    """family, given -> given family_place."""
    split = F.split(name, ",")
    return F.concat(F.trim(F.get(split, F.lit(1))), F.lit(" "), F.trim(F.get(split, F.lit(0))), F.lit("_"), place)


def without_titles(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"(?U)^((mrs?|ms|hr|herr|frau|dr|prof)\.? +)+", ""))


def name_tokens(name: Column, leave: list[str]) -> Column:
    """Words of more than two letters, without punctuation and the given words."""
    words = F.transform(F.split(F.lower(name), " "), lambda w: F.regexp_replace(w, r"[.,;:&+()]", ""))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(F.array(*[F.lit(x) for x in leave]), w))


def without_digits(text: Column) -> Column:
    return F.translate(text, "0123456789", "")


def subscript(text: Column) -> Column:
    return F.translate(text, "0123456789", "₀₁₂₃₄₅₆₇₈₉")


def age(birth: Column, at: str = "2020-11-15") -> Column:
    """Whole years at a date; -9999 if the birth date, yyyy-MM-dd or yyyyMMdd, is none."""
    day = F.try_to_timestamp(F.trim(F.translate(birth, "-*", "")), F.lit("yyyyMMdd"))
    return F.coalesce(F.floor(F.datediff(F.lit(at).cast("date"), day.cast("date")) / 365.2425).cast("int"), F.lit(-9999))


def bin_of(value: Column, edges: list[float], unknown: str) -> Column:
    """Label of the right-closed bin (a, b]; the last has no end. What lies outside is unknown."""
    out = F.lit(unknown)
    for a, b in zip(edges, [*edges[1:], None], strict=True):
        inside = (value > a) if b is None else (value > a) & (value <= b)
        out = F.when(inside, f">{a:g}" if b is None else f"{a:g}-{b:g}").otherwise(out)
    return out


def age_or_unknown(birth: Column, name: Column, klass: Column, oldest: int = 101, unknown_name: str = "unbekannt", unknown_class: int = 26) -> tuple[Column, Column, Column]:
    """Age, name and class; who would be older than possible becomes an unknown owner."""
    years = age(birth)
    gone = years > oldest
    return years, F.when(gone, F.lit(unknown_name)).otherwise(name), F.when(gone, F.lit(unknown_class)).otherwise(klass)


#: What an owner without an address gets, as the register spells it.
NO_ADDRESS = "unkown 1, 00000 unkown"


def _first_of(parts_: Column, patterns: tuple[str, str]) -> Column:
    """Of the parts, in order, the first that either pattern is found in; else empty."""
    found = F.filter(parts_, lambda p: matches_any(p, patterns))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def addresses_of(owner: Column, raw: Column) -> Column:
    """The addresses of an owner in a raw entry: after each place where the owner stands, of the next two comma parts the street and the postcode with place. Alternatives, each once, in order, joined by _."""
    rest = F.slice(F.split(raw, F.concat(F.lit("\\Q"), owner, F.lit("\\E"))), F.lit(2), F.lit(1 << 30))

    def one(after: Column) -> Column:
        two = F.slice(F.split(F.regexp_replace(after, "^,+|,+$", ""), ","), 1, 2)
        both = let(two, lambda x: F.trim(F.regexp_replace(F.concat(_first_of(x, STREET), F.lit(","), _first_of(x, PLACE)), "^,+|,+$", "")))
        return let(both, lambda x: F.when(F.length(x) > 1, x).otherwise(NO_ADDRESS))

    # what stands between two occurrences is all that the first is followed by, as only two parts are looked at
    return F.array_join(F.array_sort(F.array_distinct(F.transform(rest, one))), "_")


def all_addresses(owners_: Column, raw: Column) -> Column:
    """Of each owner in a list, joined by ' | '."""
    return F.array_join(F.transform(owners_, lambda o: addresses_of(o, raw)), " | ")


def shortest_two(text: Column, joint: str = "_") -> tuple[Column, Column]:
    """The two shortest alternatives; of equally long ones those that come first."""
    trimmed = parts(text, joint)
    ordered = F.array_sort(F.transform(trimmed, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("x"))))
    return F.get(ordered, F.lit(0))["x"], F.get(ordered, F.lit(1))["x"]


def one_address(text: Column, alike: Column, threshold: float, joint: str = "_") -> Column:
    """Of alternatives whose two shortest are more than `threshold` alike, the longer of these; else all, as they are. alike: the similarity of shortest_two()."""
    return F.when(alike > threshold, shortest_two(text, joint)[1]).otherwise(text)


def without_nobility(name: Column, words: list[str]) -> Column:
    """A name 'family, given' whose family part has several words loses the first occurrence of each of the words there."""
    family, given = F.get(F.split(name, ",", 2), F.lit(0)), F.get(F.split(name, ",", 2), F.lit(1))

    def without(kept: Column, word: Column) -> Column:
        at = F.array_position(kept, word).cast("int")
        rest = F.concat(F.slice(kept, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(kept, at + 1, F.size(kept)))
        return F.when((F.size(kept) > 1) & (at > 0), rest).otherwise(kept)

    short = F.array_join(F.aggregate(F.array(*[F.lit(w) for w in words]), F.split(F.trim(family), " "), without), " ")
    return F.when(given.isNull(), short).otherwise(F.concat(short, F.lit(","), given))


def rule_chain(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Replacements by regular expression, one after the other."""
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, text)


def padded_postcode(text: Column, country: str = "DE") -> Column:
    """The five digits of a postcode: without a country prefix, zeros in front of four digits; empty if there is none."""
    plain = F.regexp_replace(F.trim(text), rf"^{country}-", "")
    digits = F.regexp_extract(plain, r"(\d{4,5})", 1)
    return F.when(F.length(digits) > 0, F.lpad(digits, 5, "0")).otherwise("")


def separated(text: Column, n: int, delimiter: str = ",") -> list[Column]:
    """n trimmed parts, the last with all that is left; null where there is none."""
    split = F.split(text, "\\Q" + delimiter + "\\E", n)
    return [F.trim(F.get(split, F.lit(i))) for i in range(n)]


def by_length(array: Column) -> Column:
    """Elements in order of their length, then of the alphabet."""
    return F.transform(F.array_sort(F.transform(array, lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), lambda s: s["x"])


def positions(array: Column, item) -> Column:
    """All places of an item, from 0."""
    return F.filter(F.transform(array, lambda x, i: F.when(x == item, i)), lambda i: i.isNotNull())


def merged(a: Column, b: Column) -> Column:
    """Two maps as one; where both have a key, b's value."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def is_private(name: Column, keywords: list[str]) -> Column:
    """1 for a name with a comma and none of the keywords, else 2."""
    return F.when(F.contains(name, F.lit(",")) & ~has_any(F.lower(name), keywords), 1).otherwise(2)
