"""Ordered rule tables turned into expressions: category, house, region, country, eras, places.

A table is a plain sequence, so callers may pass their own; order is priority. Each
becomes one CASE chain that stays inside code generation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinframe.functions.text import norm, strip_accents, trim_chars

# ---- fixed values -----------------------------------------------------------

CATEGORIES: Sequence[tuple[str, str, str, Sequence[str]]] = (
    ("royal", "Royalty", "#e8b820", (r"\brey\b", r"\breina\b", r"\brei\b", r"\brainha\b", r"\bemperador\b", r"\bemperatriz\b", r"\bemperor\b", r"\bempress\b", r"\bduque\b", r"\bduquesa\b", r"\bduke\b", r"\bduchess\b", r"\binfante\b", r"\binfanta\b", r"\bprincipe\b", r"\bprincesa\b", r"\bprince\b", r"\bprincess\b", r"\bking\b", r"\bqueen\b")),
    ("noble", "Nobility", "#c83040", (r"\bconde\b", r"\bcondesa\b", r"\bcount\b", r"\bcountess\b", r"\bmarques\b", r"\bmarquesa\b", r"\bmarquis\b", r"\bmarquess\b", r"\bvizconde\b", r"\bviscount\b", r"\bbaron\b", r"\bbaronesa\b", r"\bsenor de\b", r"\bsenora de\b", r"\bsenhor d", r"\bsenhora d", r"\bricohombre\b", r"\bmosen\b", r"\blord\b", r"\blady\b", r"^d\. ", r"\bdom\b", r"\bdona\b")),
    ("clergy", "Clergy", "#9040c0", (r"\bfray\b", r"\bfr\.\b", r"\bobispo\b", r"\bbispo\b", r"\barzobispo\b", r"\barcebispo\b", r"\bpresbitero\b", r"\bclerigo\b", r"\babade\b", r"\bdiacono\b", r"\bdeacon\b", r"\bbishop\b", r"\bcardenal\b", r"\bcardinal\b")),
    ("military", "Military / Conquest", "#2d78d8", (r"\bcapitan\b", r"\bcaptain\b", r"\bconquistador", r"\bmaese de campo\b", r"\bmaestre de campo\b", r"\balferez\b", r"\balferes\b", r"\bcomendador\b", r"\bgeneral\b", r"\badelantado\b", r"\bsargento\b", r"\bteniente\b", r"\bsoldado\b", r"\bcoronel\b")),
    ("official", "Office / Civic", "#18a870", (r"\balcalde\b", r"\balcaide\b", r"\bjurado\b", r"\bregidor\b", r"\bgobernador\b", r"\boidor\b", r"\bescribano\b", r"\bcorregidor\b", r"\btesorero\b", r"\bcontador\b", r"\bencomendero\b", r"\bgovernor\b")),
    ("indigenous", "Indigenous", "#c86828", (r"\bhuachichil\b", r"\bguachichil\b", r"\bindigenous\b", r"\bindia\b", r"\bindio\b", r"\bcacique\b", r"\bcacica\b", r"\bnahua\b", r"\bmexica\b", r"\bazteca\b", r"\btlaxcalteca\b")),
)
UNTITLED = ("untitled", "Untitled", "#7a6e5a")

#: Wider table for rebuilt graphs, which gives the category alone.
WIDE_CATEGORIES: Sequence[tuple[str, Sequence[str]]] = (
    ("royal", (r"\brey\b", r"\breina\b", r"\brei\b", r"\brainha\b", r"\bduque\b", r"\bduquesa\b", r"\bduke\b", r"\bduchess\b", r"\bduc de\b", r"\bduc d[e']", r"\bduchesse\b", r"\bherzog\b", r"\bherzogin\b", r"\bhertog\b", r"\binfante\b", r"\bprince\b", r"\bprincess\b", r"\bprincep\b", r"\bprincipe\b", r"\bking\b", r"\bqueen\b", r"\bemperor\b", r"\bempress\b", r"\bkaiser\b", r"\btsar\b", r"\bczar\b", r"\bkong\b", r"\bkoning\b", r"\bemir\b", r"\bcaliph\b", r"\bsultan\b", r"\bregent\b", r"\bmayor of\b", r"\bunder.king\b", r"\bhigh king\b")),
    ("noble", (r"\bconde\b", r"\bcondesa\b", r"\bcount\b", r"\bcountess\b", r"\bcomte\b", r"\bcomtesse\b", r"\bcomtessa\b", r"\bmarques\b", r"\bmarkgraf\b", r"\bmargrave\b", r"\bmargraf\b", r"\bvizconde\b", r"\bvicomte\b", r"\bvicomtesse\b", r"\bviscount\b", r"\bviscountess\b", r"\bgraf\b", r"\bgraaf\b", r"\bgrafin\b", r"\bbaron\b", r"\bjarl\b", r"\bseigneur\b", r"\bsenor de\b", r"\bsenora de\b", r"\blord\b", r"\blady\b", r"^d\. ", r"\bdom\b", r"\bdona\b", r"\bmosen\b")),
    ("clergy", (r"\bfray\b", r"\bobispo\b", r"\barzobispo\b", r"\bbishop\b", r"\bcardenal\b", r"\bcardinal\b", r"\babbot\b", r"\babbess\b", r"\babbade\b", r"\bprior\b", r"\bpriore\b", r"\barchdeacon\b", r"\bdeacon\b")),
    ("military", (r"\bcapitan\b", r"\bcaptain\b", r"\bconquistador", r"\bcomendador\b", r"\badelantado\b", r"\bgeneral\b", r"\bmarshal\b", r"\bconstable\b", r"\badmiral\b", r"\bseneschal\b")),
    ("official", (r"\balcalde\b", r"\bgobernador\b", r"\boidor\b", r"\bcorregidor\b", r"\bregidor\b")),
    ("indigenous", (r"\bcacique\b", r"\bindio\b", r"\bindia\b")),
)
#: Rulers whose stored name holds no title.
KNOWN_ROYALS = ("charlemagne", "charles martel", "pepin the short", "clovis i", "clovis")
CATEGORY_TYPOS = {"nobility": "noble", "nobles": "noble"}

HOUSES: Sequence[tuple[str, str]] = (
    (r"\bjimenez\b|\bximenez\b|\bximenes\b", "Jiménez"), (r"\btrastamara\b", "Trastámara"), (r"\bplantagenet\b", "Plantagenet"), (r"\bcapet(ian)?\b", "Capetian"),
    (r"\bhohenstaufen\b", "Hohenstaufen"), (r"\bhabsburg\b", "Habsburg"), (r"\bwittelsbach\b", "Wittelsbach"), (r"\bvalois\b", "Valois"),
    (r"\bborgo[nñ]a\b|\bburgund\w+", "Burgundy"), (r"\bde\s+anjou\b|\bd.anjou\b", "Anjou"), (r"\bde\s+normandie?\b|\bnormandy\b", "Normandy"), (r"\bde\s+champagne\b", "Champagne"),
    (r"\bde\s+lara\b", "Lara"), (r"\bde\s+haro\b|\bde\s+vizcaya\b", "Haro"), (r"\bde\s+castro\b|\bcastelhano\b", "Castro"), (r"\bde\s+guzman\b", "Guzmán"),
    (r"\bde\s+sarmiento\b", "Sarmiento"), (r"\bde\s+manrique\b", "Manrique"), (r"\bde\s+villamayor\b", "Villamayor"), (r"\bde\s+manzanedo\b", "Manzanedo"),
    (r"\bde\s+azagra\b", "Azagra"), (r"\bde\s+cifuentes\b", "Cifuentes"), (r"\bde\s+brag[aâ]n[cç]a?\b", "Bragança"), (r"\bde\s+sousa\b", "Sousa"),
    (r"\bde\s+maia\b", "Maia"), (r"\bde\s+tougues\b|\bde\s+toug[uo]es\b", "Tougues"), (r"\bde\s+tolosa\b|\bde\s+toulouse\b", "Toulouse"), (r"\bde\s+corral\b|\bdel\s+corral\b", "Del Corral"),
    (r"\bde\s+bobadilla\b", "Bobadilla"), (r"\bde\s+guevara\b", "Guevara"), (r"\bde\s+mendoza\b", "Mendoza"), (r"\bde\s+zuniga\b|\bde\s+z[uú][nñ]iga\b", "Zúñiga"),
    (r"\bde\s+velasco\b", "Velasco"), (r"\bde\s+padilla\b", "Padilla"), (r"\bde\s+quinos\b|\bde\s+qui[nñ]ones\b", "Quiñones"), (r"\bde\s+osorio\b", "Osorio"),
    (r"\bde\s+pimentel\b", "Pimentel"), (r"\bde\s+ribera\b", "Ribera"), (r"\bfern[aá]ndez\s+de\s+castro\b", "Castro"), (r"\bbraganca\b", "Bragança"),
)
#: Kingdoms, cities and articles that aren't houses.
NOT_HOUSES = (
    "leon castilla castile navarra navarre portugal aragon pamplona galicia toledo sevilla murcia cordoba jaen badajoz caceres burgos palencia valladolid zamora salamanca avila segovia soria "
    "guadalajara cuenca huesca zaragoza tarragona barcelona lerida gerona the la las los el un una"
).split()

COUNTRY_HINTS: Sequence[tuple[str, str]] = (
    ("mexico", "Mexico"), ("méxico", "Mexico"), ("spain", "Spain"), ("españa", "Spain"), ("espana", "Spain"), ("espania", "Spain"), ("portugal", "Portugal"),
    ("italy", "Italy"), ("italia", "Italy"), ("france", "France"), ("francia", "France"), ("united states", "United States"), ("usa", "United States"),
    ("england", "England"), ("inglaterra", "England"), ("colombia", "Colombia"), ("peru", "Peru"), ("perú", "Peru"), ("chile", "Chile"), ("argentina", "Argentina"),
)

PLACEHOLDER = r"^(n\.?\s*n\.?|no name|\(no name\)|<private>|private|ficticious|fictitious|mother|father|unknown|desconocido|desconcido|\-)$"
WIDE_PLACEHOLDER = r"^(n\.?\s*n\.?(\s+n\.?\s*n\.?)*|no name|\(no name\)|<private>|private|fictitious?|mother|father|unknown|desconoc[io]d[ao]|\-)$"

_RULERS = "rey|reina|rei|rainha|king|queen|emperor|empress|duque|duquesa|duke|duchess|grand\\s+duke|infante|infanta|principe|princesa|prince|princess|conde|condesa|count|countess|marques|marquesa|marquis|marquess|vizconde|viscount|baron|baronesa|se[nñ]or(?:a)?|senhor(?:a)?|lord|lady|gobernador|governor|alcalde|alcaide|adelantado|comendador|obispo|bispo|arzobispo|archbishop"
REGION = rf"(?iu)(?U)\b(?:{_RULERS})\s+(?:de(?:\s+(?:la|las|los|el|o|a|os|as))?|of|del|da|do)\s+([A-ZÁÉÍÓÚÀÈÌÒÙÑÃÕÂÊÎÔÛËÏÜÇ][^,;()\n]{{1,60}})"

_CLAUSE_TITLES = "rey|reina|rei|conde|condesa|duque|duquesa|senhor|senor|senora|marques|vizconde|baron|capitan|conquistador|alcalde|alcaide|alferez|alferes|comendador|general|adelantado|jurado|regidor|gobernador|obispo|bispo|fray|maese de campo"
TITLE_CLAUSE = rf"(?iu)(?U),\s*([^,;]*\b(?:{_CLAUSE_TITLES})[^,;]*)"
LEADING_TITLE = r"(?iu)(?U)^\s*((?:capit[aá]n(?:\s+general)?|conquistador[a]?|comendador|maese de campo|alf[eé]re[zs](?:\s+real)?|mos[eé]n|fray|don|do[ñn]a|d\.|capit[aã]o)\b[\w\s]*?)\b"

#: Words that differ by language and say nothing in merge keys, and titles in one language.
PREPOSITIONS = r"\b(de|del|des|di|du|von|van|of|y|e|la|el|le|les|los|las|the|a|an)\b"
TITLE_WORDS = {
    "rey": "king", "reina": "queen", "rei": "king", "rainha": "queen", "conde": "count", "condesa": "countess", "comte": "count", "comtesse": "countess", "comde": "count", "comdes": "count", "duque": "duke",
    "duquesa": "duchess", "senor": "lord", "senora": "lady", "marques": "marquis", "marquesa": "marquess", "vizconde": "viscount", "obispo": "bishop", "arzobispo": "archbishop", "capitan": "captain", "gobernador": "governor", "infanta": "infante",
}

ERAS: Sequence[tuple[int, int, str]] = (
    (607, 718, "Pre-Reconquista Iberia"), (718, 910, "Kingdom of Asturias"), (910, 1037, "Kingdoms of León & Navarre"), (1037, 1200, "Castile, Aragon & the Crusades"), (1200, 1400, "Crown of Castile"),
    (1400, 1492, "Late Medieval Iberia"), (1492, 1550, "Conquest of New Spain"), (1550, 1700, "Colonial Mexico"), (1700, 1821, "Late Colonial & Bourbon Era"), (1821, 1910, "Independent Mexico"), (1910, 1990, "Modern Mexico"),
)

COUNTRY_PLACES: Sequence[tuple[str, float, float]] = (
    ("Spain", 40.00, -3.50), ("France", 46.00, 2.50), ("Portugal", 39.50, -8.00), ("England", 52.50, -1.50), ("Italy", 42.50, 12.50), ("Mexico", 23.00, -102.00), ("United States", 37.00, -95.00),
)
REGION_PLACES: Sequence[tuple[str, float, float]] = (
    ("Asturias", 43.40, -6.00), ("León", 42.60, -5.57), ("Leon", 42.60, -5.57), ("Castilla", 41.80, -4.00), ("Castile", 41.80, -4.00), ("Castilla y León", 41.50, -4.50), ("Navarra", 42.70, -1.50), ("Navarre", 42.70, -1.50),
    ("Pamplona", 42.82, -1.64), ("Aragón", 41.60, -0.90), ("Aragon", 41.60, -0.90), ("Cataluña", 41.60, 1.80), ("Catalonia", 41.60, 1.80), ("Vizcaya", 43.28, -2.70), ("Galicia", 42.80, -8.00), ("Galicie", 42.80, -8.00),
    ("Coimbra", 40.21, -8.42), ("Portugal", 39.50, -8.10), ("Sevilla", 37.39, -5.99), ("Toledo", 39.86, -4.02), ("Burgos", 42.34, -3.70), ("España", 40.41, -3.70), ("Spain", 40.41, -3.70), ("Extremadura", 39.20, -6.15),
    ("Andalusia", 37.50, -4.50), ("Granada", 37.18, -3.60), ("Lara", 42.05, -3.71), ("Soria", 41.76, -2.46), ("Albacete", 39.00, -1.86), ("Palencia", 42.01, -4.53), ("Mérida", 38.92, -6.35), ("Salamanca", 40.97, -5.66),
    ("Valladolid", 41.65, -4.72), ("Cabrera", 41.82, 2.16), ("Trastámara", 43.10, -7.50), ("Maia", 41.23, -8.62), ("Monterroso", 42.60, -7.84), ("Monforte de Lemos", 42.52, -7.51), ("Villanueva de la Serena", 38.98, -5.79),
    ("Ribadouro", 41.08, -8.21), ("Bragança", 41.81, -6.76), ("Celanova", 42.15, -7.95), ("Jerez de la Frontera", 36.69, -6.14), ("France", 46.00, 2.50), ("Toulouse", 43.60, 1.44), ("Gascogne", 43.70, -0.50), ("Gascony", 43.70, -0.50),
    ("Anjou", 47.47, -0.55), ("Burgundy", 47.00, 4.85), ("Bourgogne", 47.00, 4.85), ("Lorraine", 48.70, 6.18), ("Normandy", 49.00, 0.50), ("Normandie", 49.00, 0.50), ("Provence", 43.80, 5.50), ("Bretagne", 48.20, -2.90),
    ("Brittany", 48.20, -2.90), ("Comminges", 43.05, 0.58), ("Foix", 42.96, 1.60), ("Flanders", 51.00, 3.50), ("Hainaut", 50.38, 4.04), ("Champagne", 48.80, 4.00), ("Blois", 47.59, 1.33), ("Poitou", 46.58, 0.34), ("Poitiers", 46.58, 0.34),
    ("Languedoc", 43.60, 3.88), ("Vermandois", 49.80, 3.30), ("Corbeil", 48.62, 2.48), ("Bigorre", 43.10, 0.00), ("Carcassonne", 43.21, 2.35), ("Béziers", 43.35, 3.22), ("Narbonne", 43.18, 3.00), ("Narbona", 43.18, 3.00), ("Forez", 45.74, 3.86),
    ("Gévaudan", 44.52, 3.50), ("Millau", 44.10, 3.08), ("Rouergue", 44.35, 2.57), ("Melgueil", 43.52, 4.05), ("Aurillac", 44.93, 2.44), ("Brioude", 45.30, 3.38), ("Montpellier", 43.61, 3.88), ("Vence", 43.72, 7.11), ("Sisteron", 44.20, 5.94),
    ("Forcalquier", 43.96, 5.78), ("Sabran", 44.05, 4.64), ("Comtat", 44.05, 4.90), ("Chalon", 46.78, 4.85), ("Tonnerre", 47.86, 3.98), ("Semur", 47.49, 4.34), ("Nevers", 46.99, 3.16), ("Dijon", 47.32, 5.04), ("Mayenne", 48.30, -0.61),
    ("Thouars", 46.98, -0.22), ("Saumur", 47.26, -0.08), ("Preuilly", 46.85, 0.93), ("Bueil", 47.55, 0.55), ("Chartres", 48.45, 1.49), ("Nogent", 48.51, 3.50), ("Montfort", 48.76, 0.47), ("Ramerupt", 48.44, 4.30), ("Roucy", 49.43, 3.80),
    ("Vergy", 47.22, 5.00), ("Coucy", 49.52, 3.32), ("Montdidier", 49.65, 2.57), ("Gometz", 48.68, 2.12), ("Beaugency", 47.78, 1.63), ("Pallars", 42.40, 1.00), ("Urgel", 42.10, 1.10), ("Cerdanya", 42.40, 1.90), ("Besalú", 42.20, 2.70),
    ("Ribagorza", 42.30, 0.50), ("Castellvell", 41.45, 1.50), ("Cabrera (Girona)", 41.72, 2.76), ("Moncada", 41.50, 2.19), ("Gurb", 41.95, 2.25), ("Tost", 42.10, 1.28), ("England", 52.50, -1.50), ("Scots", 56.50, -3.50), ("Scotland", 56.50, -3.50),
    ("Italy", 42.50, 12.50), ("Canavese", 45.40, 7.80), ("Saxony", 51.00, 13.00), ("Swabia", 48.00, 9.50), ("Hungary", 47.00, 19.00), ("Bohemia", 50.00, 15.50), ("Mysia", 40.20, 28.00), ("Mexico", 23.00, -102.00), ("Zacatecas", 22.77, -102.58),
    ("Jalisco", 20.67, -103.35), ("Jerez de Garcia Salinas", 22.65, -102.98), ("Jerez", 22.65, -102.98), ("District Of Jerez", 22.65, -102.98), ("san jose de la Isla", 22.05, -102.30), ("Jerez de García Salinas", 22.65, -102.98),
    ("Nueva Vizcaya", 26.00, -106.00), ("Guanajuato", 21.00, -101.26), ("Michoacán", 19.50, -101.70), ("Veracruz", 19.18, -96.14), ("Ciudad de México", 19.43, -99.13), ("Nueva España", 23.00, -102.00), ("United States", 37.00, -95.00),
)

# ---- expressions ------------------------------------------------------------


def first_match(c: Column, table: Sequence[tuple[str, str]], otherwise: Column) -> Column:
    """The value of the first row whose pattern is found."""
    chain = reduce(lambda e, rule: (e.when if isinstance(e, Column) else F.when)(c.rlike(rule[0]), rule[1]), table, None)
    return otherwise if chain is None else chain.otherwise(otherwise)


def any_of(patterns: Sequence[str]) -> str:
    """One pattern for several: those that open at a word boundary share the boundary and
    their first letters, so a position inside a word is given up at once."""
    by_letter: dict[str, list[str]] = {}
    rest = []
    for p in patterns:
        if p.startswith(r"\b") and p[2:3].isalpha():
            by_letter.setdefault(p[2], []).append(p[3:])
        else:
            rest.append(p)
    words = [f"{letter}(?:{'|'.join(tails)})" for letter, tails in by_letter.items()]
    return "|".join(([rf"\b(?:{'|'.join(words)})"] if words else []) + rest)


def classify(name: Column, categories: Sequence = CATEGORIES) -> Column:
    """Category key of a name; categories in order, one alternation each."""
    table = [(any_of(row[-1]), row[0]) for row in categories]
    return first_match(F.lower(strip_accents(name)), table, F.lit(UNTITLED[0]))


def classify_wide(name: Column) -> Column:
    """Category key for rebuilt graphs: well-known rulers first, then the wider table."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(strip_accents(name)), "[^a-z ]+", ""), r"\s+", " "))
    return F.when(bare.isin(*KNOWN_ROYALS), "royal").otherwise(classify(name, WIDE_CATEGORIES))


def title_phrase(name: Column, category: Column) -> Column:
    """A readable title: a clause with a title word, a leading honorific, or the category."""
    filled = lambda c: F.when(c != "", c)
    clause, lead = (F.trim(F.regexp_extract(name, p, 1)) for p in (TITLE_CLAUSE, LEADING_TITLE))
    return F.when(category == UNTITLED[0], "").otherwise(F.coalesce(filled(clause), filled(lead), F.initcap(category)))


def house_of(name: Column, houses: Sequence[tuple[str, str]] = HOUSES) -> Column:
    """House by the ordered table, else the first ``de/del/da/do Surname`` that isn't a place."""
    found = F.regexp_extract(name, r"(?U)\b(?:de[l]?|d[ao])\s+([A-ZÁÉÍÓÚÑ][a-záéíóúñ]{3,})\b", 1)
    return first_match(F.lower(strip_accents(name)), houses, F.when(norm(found).isin(NOT_HOUSES), "").otherwise(found))


def region_of(name: Column) -> Column:
    """The territory of an embedded title, cut at conjunctions and punctuation."""
    found = trim_chars(F.regexp_extract(name, REGION, 1), " ,;.()")
    found = F.get(F.split(found, r"\s+(?:y|e|and|ou|und|&)\s+", 2), F.lit(0))
    return trim_chars(F.get(F.split(found, r"\s*[,;(]", 2), F.lit(0)), " ,;.")


def country_of(segment: Column, hints: Sequence[tuple[str, str]] = COUNTRY_HINTS) -> Column:
    """The country hinted at by the last comma-separated token that has a hint."""

    def hinted(token: Column) -> Column:
        return reduce(lambda e, hint: (e.when if isinstance(e, Column) else F.when)(F.contains(token, F.lit(hint[0])), hint[1]), hints, None)

    tokens = F.transform(F.reverse(F.split(F.lower(segment), ",")), lambda t: hinted(t))
    return F.coalesce(F.get(F.array_compact(tokens), F.lit(0)), hinted(F.lower(segment)), F.lit(""))


def is_placeholder(normal: Column, pattern: str = PLACEHOLDER, shortest: int = 0) -> Column:
    """Whether a normalised name stands for nobody."""
    return normal.rlike(pattern) | (F.length(normal) < shortest)


def language_key(normal: Column) -> Column:
    """A normalised name without prepositions and with titles in one language."""
    words = F.filter(F.split(F.regexp_replace(normal, PREPOSITIONS, " "), " +"), lambda w: w != "")
    titles = F.create_map(*(F.lit(x) for pair in TITLE_WORDS.items() for x in pair))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(titles, w), w)), " ")


def era_of(year: Column, eras: Sequence[tuple[int, int, str]] = ERAS, otherwise: str = "Unknown Era") -> Column:
    """The first era that holds the year."""
    chain = reduce(lambda e, era: (e.when if isinstance(e, Column) else F.when)(year.between(era[0], era[1]), era[2]), eras, None)
    return chain.otherwise(otherwise)


def places(spark: SparkSession, rows: Sequence[tuple[str, float, float]]) -> DataFrame:
    """A place table (place, lat, lng); as small as its constant, so joins broadcast it."""
    return spark.createDataFrame(list(rows), "place string, lat double, lng double")
