"""Owner classes from names: an ordered list of keyword rules, folded into one expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parzelle.functions import text as T

# Class names and numbers.
CLASS_IDS = {"priv": 1, "erben": 2, "gbr": 3, "ohg": 4, "kg": 5, "ewiv": 6, "ag": 7, "gmbh": 8, "ug": 9, "lim": 10, "gmco": 11, "agco": 12, "ugco": 13, "andco": 14, "se": 15, "eg": 16, "ev": 17, "wv": 18, "stift": 19, "kirch": 20, "bvvg": 21, "gem": 22, "land": 23, "bund": 24, "verg": 25, "unbek": 26, "zweck": 27, "unwah": 28, "gemeinn": 29, "mixed": 99}

# Third level of each class from 1 to 29. The second level is its first two parts; the first level its first, but for class 6, which is 2.
LEVEL3 = ["1_1_1", "1_1_2", "1_2_1", "1_2_2", "1_2_3", "1_2_4", "2_1_1", "2_1_2", "2_1_3", "2_1_4", "2_1_5", "2_1_6", "2_1_7", "2_1_8", "2_2_1", "2_2_2", "3_1_1", "3_1_2", "3_2_2", "4_1_1", "5_1_1", "5_2_1", "5_2_2", "5_2_3", "5_2_4", "5_2_5", "5_3_1", "5_2_6", "3_2_3"]

# Long forms and their abbreviations, in this order.
ABBREVIATIONS = [("gesellschaft buergerlichen rechts", "gbr"), ("gesellschaft mit beschraenkter haftung", "gmbh"), ("mit beschraenkter haftung", "mbh"), ("kommanditgesellschaft", "kg"), ("kommandit-gesellschaft", "kg"), ("eingetragene genossenschaft", "eg"), ("aktiengesellschaft", "ag"), ("deutsche bahn", "db"), ("bundesrepublik", "brd"), ("eigentum des volkes", "edv"), ("gemeinnuetzige gmbh", "ggmbh")]

# Characters that names lose, terms at which they end, words of address parts.
CHARACTERS = [".", ";", "\\\\", "/", ":", '"', "'", "(", ")", "\\+", "?"]
ENDS = ["mit dem sitz in", "mit sitz in", ", sitz"]
ADDRESS_WORDS = ["straße", "strasse", "weg", " zum ", "dorf", "ausbau", "chausee", " ot ", " am ", " an ", "str "]

# Rules in order; w = whole word, s = part of the name.
RULES = [
    ("s", "mixed", ["& co", " &co", "& c o", "6 co", "+ co", "& go", "und co", " u co"]),
    ("s", "gemeinn", ["ggmbh", "gemeinnuetzige"]),
    ("s", "bvvg", ["bvvg", "treuhandanstalt", "bodenverwert"]),
    ("w", "gbr", ["gbr"]),
    ("w", "ohg", ["ohg"]),
    ("w", "kg", ["kg", "kommanditgesellschaft"]),
    ("w", "ewiv", ["ewiv"]),
    ("w", "ag", ["ag"]),
    ("s", "ag", ["aktiengesellschaft", "agraraktiengesellschaft"]),
    ("s", "gmbh", ["gmbh", "mbh", "mit beschraenkter haf"]),
    ("w", "ug", ["ug"]),
    ("s", "ug", ["ug haftungsbeschraenkt", "unternehmergesellschaft"]),
    ("w", "se", ["se"]),
    ("w", "lim", ["limited", "sa", "sarl", "sárl", "sàrl", "holding", "ltd"]),
    ("w", "eg", ["eg"]),
    ("s", "eg", [" e g"]),
    ("s", "kirch", ["christlich", "evangelisch", "katholisch", "kirche", "diakonie", "pfarr", "pfarrgemeinde", "abtei", "pfarrstelle", "diakonisch", "diaconat", "diakonat", "domstift", "kantorat", "predigerstelle", "stift zum", "juedisch", "kirchgemeinde", "hospital", "jewish"]),
    ("w", "ev", ["ev", "verein"]),
    ("s", "ev", [" e v", "nabu", "naturschutzbund"]),
    ("w", "wv", ["wv"]),
    ("s", "stift", ["stiftung", "naturschutzfonds", "wwf"]),
    ("w", "verg", ["edv", "rt", "lpg"]),
    ("s", "verg", ["eigentum des volkes", "des volk", "separation", "volkseigentum", "rezess"]),
    ("s", "unbek", ["unbekannt", "nicht ermittelt", "separation", "aufgegeben", "verstorben", "herrenlos", "ermittel", "nicht erfasst", "seperation"]),
    ("w", "gem", ["gemeinde"]),
    ("s", "gem", ["stadtgemeinde", "dorfgemeinde", "landgemeinde", "gemeindemitglieder", "geimeindeverwaltung", "anlieger", "anliegenden", "angrenzenden", "oeffentlich"]),
    ("s", "land", ["land brandenburg", "land brandenbung", "landkreis", "land berlin", "freistaat bayern", "land hessen", "land niedersachsen", "freistaat thueringen", "landesstrassenverwaltung", "landesbetrieb", "landesregierung", "landesvermessung", "nordrhein-westfalen", "land baden", "land sachsen-anhalt"]),
    ("s", "bund", ["bundesrepublik", "bundesanstalt", "bundesstrassenverwaltung", "brd", "bundesfinanzverwaltung", "bundesministerium", "bunderepublik"]),
    ("s", "zweck", ["zweckverband", "wasserverband", "verband"]),
    ("s", "zweck", ["verband"]),
    ("s", "erben", ["erbengemein"]),
    ("s", "gbr", ["bgb", "gbr", "gesellschaft buergerlichen r", "landwirtschaftsbetrieb"]),
    ("s", "gem", ["stadt", "amt"]),
    ("s", "eg", ["agrargenossenschaft", "produktions", "bauerngenossenschaft", "weidegenossenschaft", "waldgenossenschaft", "fischergenossenschaft", "gaertnergenossenschaft", "huefnergenossenschaft", "ackerbuergergenossenschaft"]),
    ("s", "ev", ["verein", "club"]),
    ("w", "lim", ["bv", "holding"]),
    ("s", "zweck", ["verband", "wohnungseigentuemergemeinschaft", "interessengemeinschaft", "teilnehmergemeinschaft", "guetergemeinschaft"]),
    ("s", "ohg", ["ohg"]),
    ("w", "verg", ["ddr"]),
]
# What mixed forms are, by parts of the name, then by phrases; in this order.
MIXED = [
    ("gmco", ["mbh", "co", "kg"], ["mbh & co kg", "mbh & cokg", "mbh & coko", "mbh & co ko", "gmbh u cokg", "gmbh + co kg", "mbh & co", "haftung & co", "gmbh und co", "gmbh &co"]),
    ("agco", ["ag", "co", "kg"], ["ag & co kg", "ag & go kg"]),
    ("ugco", ["ug", "co", "kg"], ["ug haftungsbeschraenkt & co kg", "ughaftungsbeschraenkt & co kg", "ug & co kg", "ug haftungebeschraenkt & cokg", "ug & cokg"]),
]
# Fixed value: whatever has this belongs to the state.
STATE_FARMS = "berliner stadtgueter"


def normalised(name: Column) -> Column:
    out = T.transliterate(T.replace_each(F.lower(name), CHARACTERS))
    for long, short in ABBREVIATIONS:
        out = F.replace(out, F.lit(long), F.lit(short))
    for end in ENDS:
        out = T.cut_at(out, end)
    return T.drop_last_part(out, ",", ADDRESS_WORDS)


def class_id(clean: Column) -> Column:
    """The first rule that holds. clean: a normalised name. One * makes a private owner; without a rule a comma does; the rest is unknown."""
    def mixed() -> Column:
        out = F.lit(CLASS_IDS["andco"])
        for name, all_of, any_of in reversed(MIXED):
            every = F.lit(True)
            for x in all_of:
                every = every & F.contains(clean, F.lit(x))
            out = F.when(every | T.has_any(clean, any_of), CLASS_IDS[name]).otherwise(out)
        return out

    out = F.when(F.contains(clean, F.lit(STATE_FARMS)), CLASS_IDS["land"]).when(F.length(F.regexp_replace(clean, "[^*]", "")) == 1, CLASS_IDS["priv"])
    for kind, name, terms in RULES:
        hit = T.has_word(clean, terms) if kind == "w" else T.has_any(clean, terms)
        out = out.when(hit, mixed() if name == "mixed" else F.lit(CLASS_IDS[name]))
    return out.when(F.contains(clean, F.lit(",")), CLASS_IDS["priv"]).otherwise(CLASS_IDS["unbek"])


def levels(klass: Column) -> tuple[Column, Column, Column]:
    """First, second and third level; null for numbers that are no class."""
    third = F.get(F.array(*[F.lit(x) for x in LEVEL3]), klass - 1)
    return F.when(klass == 6, "2").otherwise(F.substring(third, 1, 1)), F.substring(third, 1, 3), third


def combined_levels(levels_: Column) -> Column:
    """Aggregate: the classes of a network's members, each once, in order."""
    return F.array_join(F.array_sort(F.collect_set(levels_)), "_")
