"""Passenger catalogues: entries, years by header, and fields, from OCR text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.functions import text as T
from kinframe.operators.asof import STRETCH, last_seen

# ---- fixed values -----------------------------------------------------------

VOLUMES: Sequence[tuple[str, str]] = (
    ("Volumen_V_Tomo_II", "V (T.II)"), ("Volumen_V_Tomo_I", "V (T.I)"), ("Volumen_VII", "VII"), ("Volumen_VI", "VI"), ("Volumen_IV", "IV"), ("Volumen_III", "III"), ("Volumen_II", "II"), ("Volumen_I", "I"),
)
EARLY = r"(?m)(?:^|\n)\s*(\d{1,5})\s*[.·]\s*[—\-–]"
LATE = r"(?m)(?:^|\n)\s*(\d{1,5})\s*[.,]\s+(?=[A-ZÁÉÍÓÚÑÜ])"
YEAR_HEADER = r"(?iu)(?:A[ÑN][OÑ]|año)\s+(\d{4})"
YEAR_LINE = r"^\s*(15[0-9]{2})\s*$"
DESTINATION = (
    r"(?iu)(?U)\b(?:al?\s+(?:perú|peru|nuevo\s+reino\s+de\s+granada|nuevo\s+m[eé]xico|darien)|a(?:\s+la)?\s+(?:nueva\s+españa|nueva\s+galicia|santo\s+domingo|tierra\s+firme|florida|cuba|puerto\s+rico|quito|"
    r"venezuela|cartagena|santa\s+marta|chile|filipinas|brasil|yucat[aá]n|campeche|honduras|nicaragua|guatemala|panam[aá]|nombre\s+de\s+dios|buenos\s+aires|bogot[aá]|r[ií]o\s+de\s+la\s+plata))"
)
DESTINATIONS: Sequence[tuple[str, str]] = (
    ("nueva espana", "Nueva España (México)"), ("peru", "Perú"), ("santo domingo", "Santo Domingo"), ("tierra firme", "Tierra Firme"), ("cuba", "Cuba"), ("puerto rico", "Puerto Rico"), ("nueva galicia", "Nueva Galicia"),
    ("quito", "Quito"), ("venezuela", "Venezuela"), ("chile", "Chile"), ("filipinas", "Filipinas"), ("brasil", "Brasil"), ("florida", "Florida"), ("yucatan", "Yucatán"), ("campeche", "Campeche"), ("honduras", "Honduras"),
    ("nicaragua", "Nicaragua"), ("guatemala", "Guatemala"), ("panama", "Panamá"), ("nombre de dios", "Nombre de Dios"), ("buenos aires", "Buenos Aires"), ("cartagena", "Cartagena"), ("santa marta", "Santa Marta"),
    ("rio de la plata", "Río de la Plata"), ("nuevo reino de granada", "Nuevo Reino de Granada"), ("nuevo mexico", "Nuevo México"), ("darien", "Darién"),
)
DATE = r"(?iu)[—\-–]\s*(\d{1,2})\s+(enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|setiembre|oct(?:ubre)?|nov(?:iembre)?|dic(?:iembre)?)\b"
MONTHS = {"ene": 1, "feb": 2, "mar": 3, "abr": 4, "may": 5, "jun": 6, "jul": 7, "ago": 8, "sep": 9, "set": 9, "oct": 10, "nov": 11, "dic": 12}
ORIGIN = r"(?iu)(?U)\bnatural(?:es)?\s+(?:y\s+vecin(?:o|a|os|as)\s+)?de\s+([^,;.()]+)|\bvecin(?:o|a|os|as)\s+(?:y\s+natural(?:es)?\s+)?de\s+([^,;.()]+)"
PARENTS = r"(?iu)(?U)\bhij(?:o|a)s?\s+de\s+(.+?)(?:\s*[,;]\s*(?:vecin|natural|a\s|al\s|con\s|y\s+sus?\s+hij)|\s*[.—]|\z)"
NAME_ENDS = (", natural ", ", vecino ", ", vecina ", ", vecinos ", " natural de ", " vecino de ", ", hijo ", ", hija ", ", soltero", ", casado", ", clérigo", ", mercader", ", labrador", ", escudero")


def volume_label(path: Column, volumes: Sequence[tuple[str, str]] = VOLUMES) -> Column:
    chain = None
    for key, label in volumes:
        hit = F.contains(path, F.lit(key))
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise("?")


def join_lines(raw: Column) -> Column:
    """Words broken at line ends joined; line ends and runs of blanks as one blank."""
    whole = F.regexp_replace(raw, r"(?iu)([a-záéíóúñü])-\s*\n\s*([a-záéíóúñü])", "$1$2")
    return F.trim(F.regexp_replace(F.regexp_replace(whole, r"\n", " "), r"\s{2,}", " "))


def destination(text: Column) -> Column:
    found = F.regexp_extract(text, DESTINATION, 0)
    plain, chain = T.norm_voyage(found), None
    for key, shown in DESTINATIONS:
        hit = F.contains(plain, F.lit(key))
        chain = F.when(hit, shown) if chain is None else chain.when(hit, shown)
    return chain.otherwise(F.initcap(F.trim(found)))


def date(text: Column, only_short_months: bool = False) -> tuple[Column, Column]:
    """Day and month (0 if unknown). ``only_short_months`` knows oct, nov and dic alone."""
    day = F.coalesce(F.regexp_extract(text, DATE, 1).try_cast("int"), F.lit(0))
    known = {k: v for k, v in MONTHS.items() if not only_short_months or k in ("oct", "nov", "dic")}
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return day, F.coalesce(F.try_element_at(table, F.substring(T.norm_voyage(F.regexp_extract(text, DATE, 2)), 1, 3)), F.lit(0))


def origin(text: Column) -> Column:
    either = F.concat(F.regexp_extract(text, ORIGIN, 1), F.regexp_extract(text, ORIGIN, 2))
    cut = F.get(F.split(F.regexp_replace(F.trim(either), r"[.,;)]+$", ""), r"(?iu)\s+(?:hijo|hija|natural|vecino|al\s|a\s+[A-Z])", 2), F.lit(0))
    return F.regexp_replace(F.trim(cut), r"[.,;) ]+$", "")


def parents(text: Column) -> Column:
    return F.regexp_replace(F.substring(F.trim(F.regexp_extract(text, PARENTS, 1)), 1, 120), r"[.,;) ]+$", "")


def clean_name(raw: Column, is_late: Column) -> Column:
    """A name without OCR debris; capitals of late volumes in title case."""
    name = F.trim(F.regexp_replace(F.regexp_replace(raw, r"-\s*\n\s*", ""), r"\s+", " "))
    name = T.trim_chars(F.trim(F.regexp_replace(name, r"(?U)^[\W_]+", "")), ",.;:—–-·")
    doubled = name.rlike("^[A-Z]{2}[a-záéíóúñü]")
    name = F.when(doubled, F.concat(F.upper(F.substring(name, 3, 1)), F.substring(name, 2, 1), F.substring(name, F.lit(3), F.length(name)))).otherwise(name)
    return F.when(is_late & (name == F.upper(name)) & (F.length(name) > 2), F.initcap(F.lower(name))).otherwise(name)


def entries(volumes: DataFrame, only_short_months: bool = False, stretch: int | None = STRETCH) -> DataFrame:
    """Entries of whole volumes (src, value).

    A volume is late if more late than early entry marks are found. A character that
    doesn't occur in texts is put before each mark, so splitting keeps order and
    positions; the year is the last header at or before the entry.
    """
    mark = "\u0001"
    rows = volumes.withColumn("is_late", F.regexp_count("value", F.lit(LATE)) > F.regexp_count("value", F.lit(EARLY)))
    marked = F.when(F.col("is_late"), F.regexp_replace("value", f"({LATE[4:]})", mark + "$1")).otherwise(F.regexp_replace("value", f"({EARLY[4:]})", mark + "$1"))
    pieces = rows.select("src", "is_late", F.posexplode(F.split(marked, mark)).alias("pos", "piece"))
    # headers inside a piece hold for the pieces after it, so each piece carries its last one
    header = F.transform(F.regexp_extract_all("piece", F.lit(YEAR_HEADER), F.lit(1)), lambda y: y.cast("int"))
    header = F.filter(header, lambda y: y.between(1490, 1620))
    line = F.transform(F.filter(F.split("piece", "\n"), lambda x: x.rlike(YEAR_LINE)), lambda x: F.trim(x).try_cast("int"))
    last_year = F.coalesce(F.try_element_at(line, F.lit(-1)), F.try_element_at(header, F.lit(-1)))
    rows = last_seen(pieces, last_year, ["src"], "pos", "year", to=-1, stretch=stretch)
    head = F.when(F.col("is_late"), F.lit(r"^\s*(\d{1,5})\s*[.,]\s+")).otherwise(F.lit(r"^\s*(\d{1,5})\s*[.·]\s*[—\-–]"))
    number = F.when(F.col("is_late"), F.regexp_extract("piece", r"^\s*(\d{1,5})\s*[.,]\s+", 1)).otherwise(F.regexp_extract("piece", r"^\s*(\d{1,5})\s*[.·]\s*[—\-–]", 1)).try_cast("int")
    rows = rows.withColumn("num", number).where("num IS NOT NULL").withColumn("joined", join_lines(F.regexp_replace(F.col("piece"), head, F.lit(""))))
    low = F.lower("joined")
    ends = F.array_compact(F.array(*(F.when(F.instr(low, k) > 1, F.instr(low, k) - 1) for k in NAME_ENDS)))
    rows = rows.withColumn("name", clean_name(F.substring("joined", F.lit(1), F.coalesce(F.array_min(ends), F.length("joined"))), F.col("is_late")))
    references = F.regexp_count("joined", F.lit(r"\d[.,]\d{3}"))
    index_line = (references >= 4) | ((references >= 2) & F.contains(F.substring("joined", 1, 80), F.lit(":")))
    day, month = date(F.col("joined"), only_short_months)
    return rows.where((F.length("name") >= 3) & ~index_line).select(
        "src", "pos", "num", "name", origin(F.col("joined")).alias("origin"), destination(F.col("joined")).alias("destination"), parents(F.col("joined")).alias("parents"),
        "year", day.alias("day"), month.alias("month"), volume_label(F.col("src")).alias("vol"), F.substring("joined", 1, 320).alias("raw"),
    )
