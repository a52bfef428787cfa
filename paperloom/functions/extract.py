"""Typed extractors. Each pattern is shared text, each check digit is a fold over the characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.spans import explode_spans
from paperloom.functions.text import W, squeeze

# Patterns of the extractors.
EMAIL = rf"[\p{{L}}\p{{N}}_.\-+]+@[\p{{L}}\p{{N}}_.\-]+\.{W}+"
URL = r"(?i)(?:https?://|ftp://|www\.)[^\s<>\")\]]+"
URL_TAIL = ".,;:)]}\"'"
DOI = r"10\.[0-9]{4,}/[^\s\"<>)\]]+"
IBAN = r"(?<![\p{L}\p{N}_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){10,34}(?![\p{L}\p{N}_])"
BIC = r"(?<![\p{L}\p{N}_])[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?(?![\p{L}\p{N}_])"
ISBN13 = r"(?<![\p{L}\p{N}_])97[89][0-9\- ]{10,16}[0-9](?![\p{L}\p{N}_])"
ISBN10 = r"(?<![\p{L}\p{N}_])[0-9][0-9\- ]{8,12}[0-9Xx](?![\p{L}\p{N}_])"
ISSN = r"(?<![\p{L}\p{N}_])[0-9]{4}-[0-9]{3}[0-9Xx](?![\p{L}\p{N}_])"
MONEY = (r"(?i)(?:(?:[$€£¥]|USD|EUR|GBP|CHF|JPY)\s?[0-9][0-9.,]*"
         r"|[0-9][0-9.,]*\s?(?:[$€£¥]|USD|EUR|GBP|CHF|JPY|Euro|Dollar))")
NAME = r"(?:^|[^\p{L}\p{N}_])([A-Z][\p{L}\p{N}_.'\-]+(?:\s+[A-Z][\p{L}\p{N}_.'\-]+){1,3})"
PHONE = r"\+?[0-9][0-9 ()/\-]{6,}[0-9]"
PLZ_CITY = r"(?<![\p{L}\p{N}_])([1-9][0-9]{4})\s+([A-ZÄÖÜ][A-Za-zäöüß.\-/() ]{1,40})"
STREET = (r"(?i)[A-ZÄÖÜ][\p{L}\p{N}_.\-]*(?:stra(?:ß|ss)e|str\.?|weg|platz|allee|gasse|ring|damm|ufer|chaussee)"
          r"\s+[0-9]+[a-z]?")
# IBAN length by country, BIC countries, office-number labels, words that are no town.
IBAN_LENGTH = {"DE": 22, "AT": 20, "CH": 21, "NL": 18, "FR": 27, "BE": 16, "GB": 22, "IT": 27, "ES": 24, "LU": 20}
BIC_COUNTRIES = ["DE", "AT", "CH", "FR", "NL", "BE", "GB", "IT", "ES", "LU", "US"]
OFFICE_LABELS = [
    ("STEUERNUMMER", r"Steuernummer|Steuer-?Nr\.?|St\.?-?Nr\.?"),
    ("KASSENZEICHEN", r"Kassenzeichen"),
    ("AKTENZEICHEN", r"Aktenzeichen|Az\.?"),
    ("INVOICE_NO", r"Rechnungs(?:nummer|-?Nr\.?)"),
    ("CUSTOMER_NO", r"Kunden(?:nummer|-?Nr\.?)"),
]
NOT_A_TOWN = ["kundennummer", "kundennr", "rechnungsnummer", "rechnungsnr", "bitte", "ust", "ustid", "ust-id", "usti",
              "e-mail", "email", "mail", "fax", "tel", "telefon", "zimmer", "datum", "rechnung", "betrag", "summe",
              "seite", "konto", "iban", "bic", "blz", "nr", "nummer", "az", "steuernummer", "kassenzeichen",
              "aktenzeichen", "buchungszeichen", "vom", "am"]
# Function words of seven languages.
FUNCTION_WORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "for", "with", "you", "this", "are", "be", "on", "it", "as", "at", "by",
           "your", "we", "an"],
    "de": ["der", "die", "und", "das", "ist", "den", "von", "zu", "mit", "für", "sie", "ein", "eine", "auf", "nicht", "dem", "des",
           "im", "ihr", "wir", "sich", "bitte", "wörtern", "auch", "oder", "werden"],
    "fr": ["le", "la", "les", "et", "de", "des", "un", "une", "est", "que", "pour", "dans", "avec", "vous", "sur", "ne", "pas",
           "ce", "qui"],
    "es": ["el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "por", "con", "para", "su", "no", "se", "del", "es",
           "como"],
    "it": ["il", "la", "di", "che", "e", "un", "una", "per", "con", "non", "le", "si", "del", "della", "sono", "come", "anche"],
    "nl": ["de", "het", "een", "en", "van", "is", "dat", "op", "te", "niet", "met", "zijn", "voor", "aan", "ook", "wij", "uw"],
    "pt": ["não", "são", "uma", "com", "dos", "das", "para", "por", "mais", "como", "também", "ser", "está", "pelo", "pela", "já",
           "mas", "ao", "seu", "sua", "isso", "então", "muito", "conteúdo", "além"],
}
LANGUAGE_TOKEN = r"[a-zà-ÿ]+"
WEIGHT_UNIT = 420  # divisible by 1..7, so that a word shared by k languages has the whole weight 420 / k


def feature_id(kind: Column, page: Column, start: Column, value: Column) -> Column:
    """Stable id of a feature: kind and the first twelve digits of a hash over kind, page, start and value."""
    raw = F.concat(kind, F.lit("|"), page, F.lit("|"), F.coalesce(start.cast("string"), F.lit("None")), F.lit("|"), value)
    return F.concat(F.lower(kind), F.lit("-"), F.substring(F.sha1(raw), 1, 12))


def cut_tail(value: Column, chars: str = URL_TAIL) -> Column:
    return F.rtrim(value, F.lit(chars))


def features(df: DataFrame, key: str, text: str, kind: str, pattern: str, confidence: float,
             tail: str | None = None) -> DataFrame:
    """Rows ``id, page_id, type, value, confidence, start, end`` for one pattern."""
    hits = explode_spans(df, key, text, pattern)
    value = cut_tail(F.col("value"), tail) if tail else F.col("value")
    hits = hits.select(F.col(key).cast("string").alias("page_id"), value.alias("value"), "start")
    return hits.select(
        feature_id(F.lit(kind), F.col("page_id"), F.col("start"), F.col("value")).alias("id"), "page_id",
        F.lit(kind).alias("type"), "value", F.lit(float(confidence)).alias("confidence"), "start",
        (F.col("start") + F.length("value")).alias("end"))


def _digit(c: Column) -> Column:
    return F.when(c == "X", 10).otherwise(c.try_cast("int"))


def iban_valid(iban: Column) -> Column:
    """Remainder test on 97, folded over the characters so that no big number is built."""
    s = F.upper(F.regexp_replace(iban, r"\s+", ""))
    turned = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))

    def step(acc, c):
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    rest = F.aggregate(F.split(turned, ""), F.lit(0), step)
    return s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{1,30}$") & (rest == 1)


def iban_cut(raw: Column) -> Column:
    """Candidate without blanks, cut to the length of its country."""
    s = F.upper(F.regexp_replace(raw, r"\s+", ""))
    out = s
    for country, n in IBAN_LENGTH.items():
        out = F.when(s.startswith(country), F.substring(s, 1, n)).otherwise(out)
    return out


def german_bank_code(iban: Column) -> Column:
    return F.when(iban.startswith("DE") & (F.length(iban) == 22), F.substring(iban, 5, 8))


def german_account(iban: Column) -> Column:
    acc = F.ltrim(F.substring(iban, 13, 10), F.lit("0"))
    return F.when(iban.startswith("DE") & (F.length(iban) == 22), F.when(acc == "", F.lit("0")).otherwise(acc))


def ibans(df: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct IBANs of a text with their test result."""
    hits = explode_spans(df, key, text, IBAN).withColumn("iban", iban_cut(F.col("value")))
    once = hits.groupBy(key, "iban").agg(F.min("start").alias("start"))
    return once.select(
        key, "iban", "start", F.when(iban_valid(F.col("iban")), 1.0).otherwise(0.3).alias("confidence"),
        german_bank_code(F.col("iban")).alias("bank_code"), german_account(F.col("iban")).alias("account"))


def bics(df: DataFrame, key: str, text: str) -> DataFrame:
    """Bank codes near a label, or of eleven characters with a known country; the first passing place counts."""
    hits = explode_spans(df, key, text, BIC).join(df.select(key, text), key)
    near = F.substring(F.col(text), F.greatest(F.col("start") - 24, F.lit(1)), F.least(F.col("start"), F.lit(25)))
    labelled = near.rlike(r"(?i)(?<![\p{L}\p{N}_])(?:BIC|SWIFT)(?![\p{L}\p{N}_])")
    known = F.substring("value", 5, 2).isin(BIC_COUNTRIES) & (F.length("value") == 11)
    return (hits.where(labelled | known).groupBy(key, F.col("value").alias("bic"))
            .agg(F.min_by(F.when(labelled, 0.9).otherwise(0.6), F.col("start")).alias("confidence"),
                 F.min("start").alias("start")))


def _weighted(digits: Column, weight) -> Column:
    return F.aggregate(F.transform(F.split(digits, ""), lambda c, i: _digit(c) * weight(i)), F.lit(0), lambda a, x: a + x)


def book_digits(s: Column) -> Column:
    return F.upper(F.regexp_replace(s, "[^0-9Xx]", ""))


def isbn13_valid(d: Column) -> Column:
    return d.rlike("^[0-9]{13}$") & (_weighted(d, lambda i: F.when(i % 2 == 0, 1).otherwise(3)) % 10 == 0)


def isbn10_valid(d: Column) -> Column:
    return d.rlike("^[0-9]{9}[0-9X]$") & (_weighted(d, lambda i: 10 - i) % 11 == 0)


def issn_valid(d: Column) -> Column:
    return d.rlike("^[0-9]{7}[0-9X]$") & (_weighted(d, lambda i: 8 - i) % 11 == 0)


def book_numbers(df: DataFrame, key: str, text: str) -> DataFrame:
    """ISBN-13, ISBN-10 and ISSN whose check digit holds, each once per text."""
    def hits(pattern, kind):
        return df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), 0)).alias("raw"),
                         F.lit(kind).alias("kind"))

    rows = hits(ISBN13, "13").unionByName(hits(ISBN10, "10")).unionByName(hits(ISSN, "ISSN"))
    d = book_digits(F.col("raw"))
    good = ((F.col("kind") == "13") & isbn13_valid(d)) | ((F.col("kind") == "10") & isbn10_valid(d)) | (
        (F.col("kind") == "ISSN") & issn_valid(d))
    return rows.where(good).select(
        key, F.when(F.col("kind") == "ISSN", "ISSN").otherwise("ISBN").alias("type"),
        F.when(F.col("kind") == "ISSN", F.upper("raw")).otherwise(d).alias("value")).distinct()


def office_numbers(df: DataFrame, key: str, text: str) -> DataFrame:
    """Numbers behind German office labels, each once per text."""
    rows = None
    for kind, label in OFFICE_LABELS:
        pat = rf"(?i)(?:{label})\s*[:#]?\s*([0-9][0-9./\- ]{{3,40}}[0-9])"
        part = df.select(key, F.lit(kind).alias("type"), F.explode(F.regexp_extract_all(F.col(text), F.lit(pat), 1)).alias("v"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.select(key, "type", F.trim(F.col("v"), F.lit(" .-")).alias("value")).distinct()


def german_addresses(df: DataFrame, key: str, text: str) -> DataFrame:
    """Postcode and town, label words cut, with a street looked up in the 80 characters before."""
    hits = explode_spans(df, key, text, PLZ_CITY).join(df.select(key, text), key)
    plz = F.regexp_extract("value", PLZ_CITY, 1)
    toks = F.filter(F.split(F.trim(F.regexp_extract("value", PLZ_CITY, 2), F.lit(" .,-")), r"\s+"), lambda w: w != "")
    no_town = F.array(*[F.lit(x) for x in NOT_A_TOWN])

    def label(w):
        return F.array_contains(no_town, F.lower(w)) | w.rlike(r"(?i)(?:nummer|-?nr\.?|-?id)$")

    stop = F.filter(F.transform(toks, lambda w, i: F.when(label(w), i)), lambda i: i.isNotNull())
    keep = F.least(F.coalesce(F.array_min(stop), F.size(toks)), F.lit(3))
    town = F.array_join(F.slice(toks, 1, F.greatest(keep, F.lit(0))), " ")
    back = F.substring(F.col(text), F.greatest(F.col("start") - 79, F.lit(1)), F.least(F.col("start"), F.lit(80)))
    d = hits.select(key, "start", plz.alias("postcode"), town.alias("town"), F.try_element_at(
        F.regexp_extract_all(back, F.lit(STREET), 0), F.lit(-1)).alias("street"),
        F.try_element_at(toks, F.lit(1)).alias("__first"))
    return d.where((F.length("__first") >= 2) & (F.col("town") != "")).select(
        key, "postcode", "town", "street",
        F.concat(F.coalesce(F.concat(F.col("street"), F.lit(", ")), F.lit("")), F.col("postcode"), F.lit(" "), F.col("town")).alias("value"),
        F.when(F.col("street").isNotNull(), 0.8).otherwise(0.6).alias("confidence"))


def date_of(token: Column) -> Column:
    """Calendar date of a token in one of the usual written forms."""
    forms = ["yyyy-MM-dd", "dd.MM.yyyy", "d MMMM yyyy", "MMMM d, yyyy"]
    return F.coalesce(*[F.try_to_timestamp(token, F.lit(f)).cast("date") for f in forms])


DATE_TOKEN = (r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"
              r"|[0-9]{1,2} [A-Z][a-z]+ [0-9]{4}|[A-Z][a-z]+ [0-9]{1,2}, [0-9]{4}")


def dates(df: DataFrame, key: str, text: str) -> DataFrame:
    d = df.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(DATE_TOKEN), 0)).alias("seq", "token"))
    return d.select(key, "seq", "token", date_of(F.col("token")).cast("string").alias("value")).where("value IS NOT NULL")


def phone_e164(token: Column, country_code: str = "1") -> Column:
    """Digits with a leading plus; a number without one gets the given country code, a trunk zero is dropped."""
    digits = F.regexp_replace(token, "[^0-9]", "")
    return F.when(F.trim(token).startswith("+"), F.concat(F.lit("+"), digits)).otherwise(
        F.concat(F.lit("+" + country_code), F.ltrim(digits, F.lit("0"))))


def price_amount(token: Column) -> Column:
    """Amount of a money token. The last separator is the decimal one when one or two digits follow it."""
    num = F.rtrim(F.regexp_extract(token, "[0-9][0-9.,]*", 0), F.lit(".,"))
    dec = F.regexp_extract(num, "[.,]([0-9]{1,2})$", 1)
    whole = F.when(dec != "", F.regexp_replace(num, "[.,][0-9]{1,2}$", "")).otherwise(num)
    return F.concat_ws(".", F.regexp_replace(whole, "[.,]", ""), F.when(dec != "", dec)).try_cast("double")


def price_currency(token: Column) -> Column:
    return F.regexp_extract(token, r"(?i)[$€£¥]|USD|EUR|GBP|CHF|JPY|Euro|Dollar", 0)


def name_candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    """Runs of two to four capitalised words."""
    return df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(NAME), 1)).alias("value"))


ALL = {"EMAIL": (EMAIL, 0, None), "URL": (URL, 0, URL_TAIL), "DOI": (DOI, 0, URL_TAIL), "IBAN": (IBAN, 0, None),
       "BIC": (BIC, 0, None), "PRICE": (MONEY, 0, None), "PHONE": (PHONE, 0, None), "PERSON_NAME": (NAME, 1, None)}


def extract_all(df: DataFrame, key: str, text: str, only: list[str] | None = None) -> DataFrame:
    """Values of several extractors in one pass over the text: ``key, type, value``."""
    def tagged(kind, pat, group, tail):
        hits = F.regexp_extract_all(F.col(text), F.lit(pat), group)
        return F.transform(hits, lambda v: F.struct(F.lit(kind).alias("type"), (cut_tail(v, tail) if tail else v).alias("value")))

    arrays = [tagged(kind, *spec) for kind, spec in ALL.items() if only is None or kind in only]
    return df.select(key, F.explode(F.concat(*arrays)).alias("f")).select(key, "f.type", "f.value")


def function_word_table(spark) -> DataFrame:
    """Fixed table ``word, lang, rank, weight``; small by construction."""
    claims: dict[str, int] = {}
    for ws in FUNCTION_WORDS.values():
        for w in set(ws):
            claims[w] = claims.get(w, 0) + 1
    rows = [(w, lang, i, WEIGHT_UNIT // claims[w])
            for i, (lang, ws) in enumerate(FUNCTION_WORDS.items()) for w in sorted(set(ws))]
    return spark.createDataFrame(rows, "word string, lang string, rank int, weight int")


def languages(df: DataFrame, key: str, text: str) -> DataFrame:
    """Language by weighted function words: hits are joined map-side and folded per text before the shuffle."""
    toks = F.regexp_extract_all(F.lower(F.col(text)), F.lit(LANGUAGE_TOKEN), 0)
    base = df.select(key, toks.alias("__t")).withColumn("__n", F.size("__t"))
    hits = base.select(key, "__n", F.explode("__t").alias("word")).join(F.broadcast(function_word_table(df.sparkSession)), "word")
    by_lang = hits.groupBy(key, "lang").agg(F.sum("weight").alias("w"), F.min("rank").alias("rank"), F.max("__n").alias("n"))
    best = by_lang.groupBy(key).agg(F.max_by(F.struct("lang", "w", "n"), F.struct(F.col("w"), -F.col("rank"))).alias("b"))
    d = df.select(key).join(best, key, "left")
    hit = F.coalesce(F.col("b.w") / (F.lit(WEIGHT_UNIT) * F.col("b.n")), F.lit(0.0))
    return d.select(key, F.when(hit < 0.02, "und").otherwise(F.col("b.lang")).alias("detected"),
                    F.round(F.when(hit < 0.02, hit).otherwise(F.least(hit * 3.0, F.lit(0.95))), 3).alias("confidence"))


# --- letters and business records -------------------------------------------------------------------------------

# Page-number wording, document kinds, date forms, sender forms, margin wording.
PAGE_FORMS = [
    r"(?i)seite\s+([0-9]{1,3})\s+von\s+([0-9]{1,3})",
    r"(?i)seite\s+([0-9]{1,3})\s*/\s*([0-9]{1,3})",
    r"(?i)(?:^|[^\p{L}\p{N}_])([0-9]{1,3})\s*(?:of|von)\s+([0-9]{1,3})(?:$|[^\p{L}\p{N}_])",
    r"(?i)(?:^|[^\p{L}\p{N}_])page\s+([0-9]{1,3})\s*/\s*([0-9]{1,3})(?:$|[^\p{L}\p{N}_])",
    r"(?i)(?:^|[^\p{L}\p{N}_])page\s+([0-9]{1,3})()(?:$|[^\p{L}\p{N}_])",
    r"(?i)(?:^|[^\p{L}\p{N}_])seite\s+([0-9]{1,3})()(?:$|[^\p{L}\p{N}_])",
]
PAGE_BARE = r"(?:^|[^\p{L}\p{N}_])([0-9]{1,3})\s*/\s*([0-9]{1,3})(?:$|[^\p{L}\p{N}_])"
DOCTYPES = [
    ("invoice", ["rechnung", "invoice", "faktura"]),
    ("reminder", ["mahnung", "zahlungserinnerung", "reminder", "overdue"]),
    ("contract", ["vertrag", "contract", "vereinbarung", "agreement"]),
    ("offer", ["angebot", "offer", "quotation", "kostenvoranschlag"]),
    ("statement", ["kontoauszug", "statement", "abrechnung", "auflistung", "aufstellung"]),
    ("letter", ["sehr geehrte", "dear", "betreff", "schreiben"]),
]
ISO_DATE = r"(?:^|[^\p{L}\p{N}_])([0-9]{4})-([0-9]{2})-([0-9]{2})(?:$|[^\p{L}\p{N}_])"
GERMAN_DATE = r"(?:^|[^\p{L}\p{N}_])([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})(?:$|[^\p{L}\p{N}_])"


def page_number(s: Column, bare: bool = True) -> Column:
    """Struct ``page, total`` by the first wording that matches; the bare ``n/m`` form is for bands only."""
    forms = PAGE_FORMS + ([PAGE_BARE] if bare else [])
    out = F.lit(None).cast("struct<page:int,total:int>")
    for pat in reversed(forms):
        hit = F.struct(F.regexp_extract(s, pat, 1).try_cast("int").alias("page"),
                       F.regexp_extract(s, pat, 2).try_cast("int").alias("total"))
        out = F.when(s.rlike(pat), hit).otherwise(out)
    return out


def doctype(s: Column) -> Column:
    """Document kind by the first keyword group that occurs as a word."""
    low = F.lower(s)
    out = F.lit("document")
    for label, kws in reversed(DOCTYPES):
        pat = r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(kws) + r")(?:$|[^\p{L}\p{N}_])"
        out = F.when(low.rlike(pat), label).otherwise(out)
    return out


def norm_date(s: Column) -> Column:
    """ISO or German date to ``yyyymmdd``."""
    iso = F.concat(*[F.regexp_extract(s, ISO_DATE, i) for i in (1, 2, 3)])
    ger = F.concat(F.regexp_extract(s, GERMAN_DATE, 3), F.lpad(F.regexp_extract(s, GERMAN_DATE, 2), 2, "0"),
                   F.lpad(F.regexp_extract(s, GERMAN_DATE, 1), 2, "0"))
    return F.when(s.rlike(ISO_DATE), iso).when(s.rlike(GERMAN_DATE), ger)


def bib_record(key: Column, kind: str | Column, fields: list[tuple[str, Column]], sep: str = ",\n") -> Column:
    """BibTeX-like text of the non-empty fields."""
    parts = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"  {k} = {{"), v, F.lit("}"))) for k, v in fields]
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.concat_ws(sep, *parts), F.lit("\n}"))


def margin_role(t: Column) -> Column:
    """Role of an item in the page margin, tested in order."""
    nb, ne = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
    cont = rf"(?i){nb}(?:(?:Seite|Blatt)\s*[0-9]+\s*von\s*[0-9]+|Fortsetzung{ne})"
    word = (rf"(?i){nb}(?:Kassenzeichen|Kundennummer|Aktenzeichen|Steuernummer|Kontrollnummer|Rechnungsnummer|Belegnummer"
            r"|Referenz|Druck-?Nr|Buchungs)")
    ident = rf"[0-9]{{1,3}}(?:[.\-/ ][0-9]{{2,}}){{2,}}|{nb}[0-9]{{6,}}{ne}"
    page = rf"(?i){nb}(?:Seite|Page|S\.)\s*[0-9]+{ne}"
    return (F.when(t.rlike(cont), "continuity").when(t.rlike(word) | t.rlike(ident), "control_number")
            .when(t.rlike(page) | t.rlike(r"^\s*[0-9]{1,4}\s*$"), "page_number")
            .when(t.rlike("[A-Za-zÄÖÜäöüß]{2,}"), "label").otherwise("marginal"))


def marker_counts(t: Column, role: Column) -> Column:
    """Whether a margin item carries content worth showing."""
    s = F.trim(t)
    image = s.startswith("![") | s.startswith("http") | s.startswith("\\includegraphics")
    return ~image & (((role == "page_number") & s.rlike("[0-9]")) | ((F.length(s) >= 3) & s.rlike("[A-Za-zÄÖÜäöüß0-9]{2,}")))


BLOCK_RULES = [
    ("stamp", r"(?i)Deutsche\s+Post|Entgelt\s+bezahlt|(?<![\p{L}\p{N}_])DPAG(?![\p{L}\p{N}_])|Frankier"
              r"|(?<![\p{L}\p{N}_])P\s+DV(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])Porto(?![\p{L}\p{N}_])|Postvertriebsstück"),
    ("signature", r"(?i)Mit\s+freundlichen\s+Grüßen|Hochachtungsvoll|(?<![\p{L}\p{N}_])(?:i\.\s?A\.|i\.\s?V\.|ppa\.)"),
    ("footer", r"(?i)(?<![\p{L}\p{N}_])(?:HRB|HRA|Sitz|VNR)(?![\p{L}\p{N}_])|Amtsgericht|Handelsregister|USt\.?-?\s?ID"
               r"|Umsatzsteuer-?ID|Vorstand|Aufsichtsrat|Geschäftsführer|Postanschrift|Hausanschrift|Vers\.-St"),
    ("other", r"(?i)(?<![\p{L}\p{N}_])(?:bitte\s+wenden|Fortsetzung)(?![\p{L}\p{N}_])|^\s*Seite\s+[0-9]"),
    ("body", r"(?i)^\s*(?:Herrn|Herr|Frau|Firma|An\s+die|An\s+den)(?![\p{L}\p{N}_])"),
]


def block_role(t: Column, top: Column, bottom: Column) -> Column:
    """Role of a text block: wording first, then its place as a share of the page height."""
    table = F.size(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[0-9][0-9.,]*\s{2,}[0-9][0-9.,]*"))) >= 2
    out = F.when(table, "table").when(top < 0.22, "header").when(bottom > 0.82, "footer").otherwise("body")
    for role, pat in reversed(BLOCK_RULES):
        out = F.when(t.rlike(pat), role).otherwise(out)
    return out


# Spellings of a preprint id.
PREPRINT = (r"(?i)(?:arxiv:|arxiv\.org/(?:abs|pdf|e-print)/)?([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?"
            r"|[a-z\-]+(?:\.[A-Z]{2})?/[0-9]{7}(?:v[0-9]+)?)")


def preprint_id(s: Column) -> Column:
    """Preprint id from an address or token; an address of another host gives null."""
    t = F.regexp_replace(F.trim(s), r"(?i)\.pdf$", "")
    host = F.lower(F.regexp_extract(t, r"(?i)^[a-z]+://([^/?#]+)", 1))
    foreign = (host != "") & ~host.rlike(r"(^|\.)arxiv\.org$")
    got = F.regexp_extract(t, PREPRINT, 1)
    return F.when(~foreign & (got != ""), got)


def unwrap_urls(s: Column, rounds: int = 3) -> Column:
    """Join an address that a line break cut after a hyphen, or after a slash when a path goes on."""
    hyphen = r"(?i)((?:https?://|ftp://|www\.)[^\s<>\"')\]}]*-)[ \t]*\n[ \t]*(?=[^\s<>\"')\]}])"
    slash = (r"((?i:https?://|ftp://|www\.)[^\s<>\"')\]}]*/)[ \t]*\n[ \t]*"
             r"(?=[a-z0-9_~%\-]*[./][^\s<>\"')\]}]*)")
    for _ in range(rounds):
        s = F.regexp_replace(F.regexp_replace(s, hyphen, "$1"), slash, "$1")
    return s


FACTS = [
    ("accuracy", r"(?i)accuracy[^0-9]{0,12}?([0-9]{1,3}(?:\.[0-9]+)?\s*%|[01]?\.[0-9]+)"),
    ("F1 score", r"(?i)(?:^|[^\p{L}\p{N}_])F1[^0-9]{0,12}?([0-9]{1,3}(?:\.[0-9]+)?\s*%|[01]?\.[0-9]+)"),
    ("precision", r"(?i)precision[^0-9]{0,12}?([0-9]{1,3}(?:\.[0-9]+)?\s*%|[01]?\.[0-9]+)"),
    ("recall", r"(?i)recall[^0-9]{0,12}?([0-9]{1,3}(?:\.[0-9]+)?\s*%|[01]?\.[0-9]+)"),
    ("p-value", r"(?i)(?:^|[^\p{L}\p{N}_])p\s*[<=]\s*([0-9]*\.[0-9]+)"),
    ("sample size", r"(?i)(?:^|[^\p{L}\p{N}_])n\s*=\s*([0-9][0-9,]{1,8})"),
]


def facts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Reported metrics in prose, one row per metric and value; one pass over the text."""
    def tagged(name, pat):
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pat), 1),
                           lambda v: F.struct(F.lit(name).alias("metric"), v.alias("value")))

    arrays = [tagged(name, pat) for name, pat in FACTS]
    return df.select(key, F.explode(F.concat(*arrays)).alias("f")).select(key, "f.metric", squeeze(F.col("f.value")).alias("value"))
