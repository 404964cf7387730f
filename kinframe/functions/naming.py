"""Casing of names and translation of titles, as folds of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinframe.functions.text import once

# ---- fixed values -----------------------------------------------------------

PARTICLES = "de del da das do dos di e el du des van von af zu of la le les lo los las y".split()
KEEP_TOKENS = ("D.", "Dª", "Sir", "Dame", "SJ", "St.", "NN", "Ntra.", "Don", "Doña", "Sr.", "Sra.")
ORDINAL = r"(?i)^\d+(st|nd|rd|th|[º°ª]|er\.?|a\.?)$"
ROMANS = "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX XXI XXII XXIII XXIV XXV".split()

TITLES: Sequence[tuple[str, str]] = (
    (r"\breina\s+consorte\b", "Queen Consort"), (r"\breina\s+consort\b", "Queen Consort"), (r"\bcondesa\s+consorte\b", "Countess Consort"), (r"\bconde\s+consorte\b", "Count Consort"), (r"\bduquesa\s+consorte\b", "Duchess Consort"),
    (r"\bduque\s+consorte\b", "Duke Consort"), (r"\bmaese\s+de\s+campo\b", "Field Marshal"), (r"\badelantado\s+mayor\b", "Governor-General"), (r"\balcalde\s+mayor\b", "Chief Magistrate"), (r"\balguacil\s+mayor\b", "Chief Constable"),
    (r"\bmayordomo\s+del\s+rey\b", "Royal Steward"), (r"\bmayordomo\s+mayor\b", "Lord Steward"), (r"\bcapitán\s+general\b", "Captain General"), (r"\bcapitan\s+general\b", "Captain General"),
    (r"\s+y\s+del\s+", " and "), (r"\s+y\s+de\s+la\s+", " and "), (r"\s+y\s+de\s+los\s+", " and "), (r"\s+y\s+de\s+las\s+", " and "), (r"\s+y\s+de\s+", " and "), (r"\s+y\s+", " and "), (r"\s+e\s+do\s+", " and "), (r"\s+e\s+da\s+", " and "), (r"\s+e\s+", " and "),
    (r"\bde\s+la\b", "of"), (r"\bde\s+los\b", "of"), (r"\bde\s+las\b", "of"), (r"\bdel\b", "of"), (r"\bda\b", "of"), (r"\bdo\b", "of"), (r"\bdas\b", "of"), (r"\bdos\b", "of"), (r"\bdu\b", "of"),
    (r"\brey\b", "King"), (r"\breina\b", "Queen"), (r"\brei\b", "King"), (r"\brainha\b", "Queen"),
    (r"\bcondesa\b", "Countess"), (r"\bconde\b", "Count"), (r"\bduquesa\b", "Duchess"), (r"\bduque\b", "Duke"), (r"\bvizcondesa\b", "Viscountess"), (r"\bvizconde\b", "Viscount"), (r"\bmarquesa\b", "Marchioness"), (r"\bmarqués\b", "Marquess"),
    (r"\bmarques\b", "Marquess"), (r"\bbaronesa\b", "Baroness"), (r"\bbarón\b", "Baron"), (r"\bbaron\b", "Baron"), (r"\binfanta\b", "Infanta"), (r"\binfante\b", "Infante"), (r"\bseñora\b", "Lady"), (r"\bseñor\b", "Lord"), (r"\bsenhora\b", "Lady"),
    (r"\bsenhor\b", "Lord"), (r"\bprincesa\b", "Princess"), (r"\bpríncipe\b", "Prince"), (r"\bprincipe\b", "Prince"),
    (r"\bcomtesse\b", "Countess"), (r"\bcomtessa\b", "Countess"), (r"\bcomte\b", "Count"), (r"\bseigneur\b", "Lord"), (r"\bvicomtesse\b", "Viscountess"), (r"\bvicomte\b", "Viscount"), (r"\bduchesse\b", "Duchess"), (r"\bduc\b", "Duke"), (r"\bprincess\b", "Princess"),
    (r"\bherzog\b", "Duke"), (r"\bherzogin\b", "Duchess"), (r"\bmarkgraf\b", "Margrave"), (r"\blandgraf\b", "Landgrave"), (r"\bpfalzgraf\b", "Count Palatine"), (r"\bgräfin\b", "Countess"), (r"\bgraf\b", "Count"), (r"\bgravin\b", "Countess"), (r"\bgraaf\b", "Count"), (r"\bvon\b", "of"),
    (r"\barzobispo\b", "Archbishop"), (r"\bobispo\b", "Bishop"), (r"\babadesa\b", "Abbess"), (r"\babad\b", "Abbot"),
    (r"\bgobernador\b", "Governor"), (r"\badelantado\b", "Governor"), (r"\balcaide\b", "Castellan"), (r"\balcalde\b", "Mayor"), (r"\bcapitán\b", "Captain"), (r"\bcapitan\b", "Captain"), (r"\balférez\b", "Ensign"), (r"\balferez\b", "Ensign"), (r"\bmaestro\b", "Master"),
    (r"\bde\b", "of"),
    (r"\b1er?\.\s*", "1st "), (r"\b1[oº°]\b", "1st"), (r"\b2[oº°]\b", "2nd"), (r"\b3[oº°]\b", "3rd"), (r"\b(\d+)[oº°]\b", "$1th"), (r"\b2\.º\b", "2nd"), (r"\b3\.º\b", "3rd"), (r"\b(\d+)\.º\b", "$1th"),
    (r"\bOf\b", "of"), (r"\bThe\b(?!\s+[A-Z])", "the"),
)
TITLE_PLACES: Sequence[tuple[str, str]] = (
    (r"\bCastilla\b", "Castile"), (r"\bCastela\b", "Castile"), (r"\bAragón\b", "Aragon"), (r"\bNavarra\b", "Navarre"), (r"\bNavara\b", "Navarre"), (r"\bAstúrias\b", "Asturias"), (r"\bLusitânia\b", "Lusitania"),
    (r"\bAndalucía\b", "Andalusia"), (r"\bAndalucia\b", "Andalusia"), (r"\bGalicia\b", "Galicia"), (r"\bBurgonha\b", "Burgundy"), (r"\bBorgoña\b", "Burgundy"), (r"\bBourgogne\b", "Burgundy"),
)
KEEP_TITLES = (
    "Noble", "Royal", "Clergy", "Military", "Official", "Indigenous", "Conquistador", "Conquistador de la Nueva Galicia", "Conquistador de Nueva España", "Mosen", "Mosén", "mosen", "Jurado", "Maese de Campo",
    "Don", "Doña", "Dona", "D.", "D", "o Alferes", "o Conquistador", "Capitan", "Capitán",
)
LOWER_STARTS = "of and the in at to by from o a el la os as".split()


def translate_title(title: Column) -> Column:
    """A title in English: ordered substitutions, then places; bare labels stay."""
    t = F.trim(title)
    said = reduce(lambda c, rule: F.regexp_replace(c, "(?iu)(?U)" + rule[0], rule[1]), TITLES, t)
    said = reduce(lambda c, rule: F.regexp_replace(c, "(?U)" + rule[0], rule[1]), TITLE_PLACES, said)
    said = F.trim(F.regexp_replace(said, " {2,}", " "))

    def opened(said: Column) -> Column:
        head, first = F.substring(said, 1, 1), F.lower(F.split_part(said, F.lit(" "), F.lit(1)))
        lower = (head != F.upper(head)) & ~first.isin(LOWER_STARTS)
        return F.when(lower, F.concat(F.upper(head), F.substring(said, F.lit(2), F.length(said)))).otherwise(said)

    return F.when(t.isin(*KEEP_TITLES), t).otherwise(once(said, opened))


def fix_token(token: Column, is_first: Column) -> Column:
    """Casing of one token of a name."""
    # wrapping marks: each opening mark at most once, in this order, and closing ones alike
    left = F.regexp_extract(token, r"^(\(?\"?'?«?)", 1)
    rest = F.substring(token, F.length(left) + 1, F.length(token))
    right = F.regexp_extract(rest, r"(,?»?'?\"?\)?)$", 1)

    def cased(parts: Column) -> Column:
        left, right = parts["left"], parts["right"]
        bare = F.substring(token, F.length(left) + 1, F.length(token) - F.length(left) - F.length(right))
        upper, lower = F.upper(bare), F.lower(bare)
        capital = F.concat(F.substring(upper, 1, 1), F.substring(lower, F.lit(2), F.length(lower)))
        shown = (
            F.when(upper.isin(ROMANS), upper)
            .when(~is_first & lower.isin(PARTICLES), lower)
            .when((F.length(bare) >= 2) & (bare == upper) & (bare != lower) & bare.rlike(r"^\p{L}+$"), capital)
            .otherwise(bare)
        )
        return F.when(bare == "", token).otherwise(F.concat(left, shown, right))

    keep = token.isin(*KEEP_TOKENS) | token.rlike(ORDINAL) | token.rlike("^N{2,}$")
    return F.when(keep, token).otherwise(once(F.struct(left.alias("left"), right.alias("right")), cased))


def fix_name(name: Column) -> Column:
    """Casing of a full name; what follows the first comma is a title and is translated."""
    comma = F.instr(name, ",")
    own = F.when(comma > 0, F.substring(name, F.lit(1), comma - 1)).otherwise(name)
    tokens = F.filter(F.split(F.trim(own), r"\s+"), lambda t: t != "")
    fixed = F.array_join(F.transform(tokens, lambda t, i: fix_token(t, i == 0)), " ")
    rest = F.trim(F.substring(name, comma + 1, F.length(name)))
    return F.when(name == "", name).when(comma > 0, F.concat(fixed, F.lit(", "), translate_title(rest))).otherwise(fixed)
