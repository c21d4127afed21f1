"""Text normalisation as Column expressions.

Four folds stay apart on purpose: ``fold`` keeps œ, ``fold_stable`` maps it to o without changing the length,
``article_key`` spells it oe, ``fold_nfd`` strips combining marks and joins white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain forms, in the order a c e i n o u y.
ACCENTED = "àáâäãåçèéêëìíîïñòóôöõùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

# Stop words of the French body index, folded.
STOPWORDS = (
    "a ai aie aient aies ait au aurai auraient aurais aurait aurez auriez aurions aurons auront aux avaient avais avait avec avez aviez avons ayant ayez ayons "
    "c ce ceci cela ces cet cette d dans de des du elle en es et etaient etais etait etant etee etees etes etiez etions eu eue eues eumes eurent eus eusse eussent "
    "eusses eussiez eussions eut eutes eux fumes furent fus fusse fussent fusses fussiez fussions fut futes ici il ils j je l la le les leur leurs lui m ma mais me "
    "meme mes moi mon n ne nos notre nous on ont ou par pas pour qu que quel quelle quelles quels qui s sa sans se sera serai seraient serais serait seras serez "
    "seriez serions serons seront ses soi soient sois soit sont soyez soyons suis sur t ta te tes toi ton tu un une vos votre vous y"
).split()

# Words that may not open or close a suggestion, and words that no suggestion contains.
BORDER_WORDS = "apres autre autres avant celle celles celui ceux chaque entre moins outre plus selon sous tous tout toute toutes tres vers".split()
CLAUSE_BREAKERS = (
    "ainsi alors aussi comme deja doit doivent donc dont elle elles encore enfin ensuite est ete etre il ils lorsqu lorsque notamment on peut peuvent puis puisque quand "
    "seulement si sinon toutefois"
).split()

TOKEN = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"


def fold(x: Column) -> Column:
    return F.translate(F.lower(x), ACCENTED, PLAIN)


def fold_stable(x: Column) -> Column:
    """Length-preserving: œ and æ become one letter, blanks become spaces."""
    return F.translate(F.lower(x), ACCENTED + "œæ\t\n\r  ’", PLAIN + "oa     '")


def fold_nfd(x: Column) -> Column:
    """Lower case without accents, typographic apostrophes plain, white space joined."""
    return F.trim(F.regexp_replace(F.translate(F.lower(x), ACCENTED + "’", PLAIN + "'"), r"\s+", " "))


def tokens(x: Column) -> Column:
    """Body tokens: runs of letters and digits with inner hyphens, folded."""
    return F.transform(F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0)), fold)


def is_stopword(x: Column) -> Column:
    return x.isin(STOPWORDS)


def content_tokens(x: Column) -> Column:
    return F.filter(tokens(x), lambda t: ~is_stopword(t))


def content_runs(toks: Column, least: int) -> Column:
    """Runs of tokens between stop words, of at least ``least`` tokens."""
    joined = F.concat_ws("\x01", F.transform(toks, lambda t: F.when(is_stopword(t), F.lit("\x02")).otherwise(t)))
    runs = F.transform(F.split(joined, "\x02"), lambda r: F.filter(F.split(r, "\x01"), lambda t: t != ""))
    return F.filter(runs, lambda r: F.size(r) >= least)


def article_key(x: Column) -> Column:
    """Public key of an article number: L. 761-1, L761-1 and l 761-1 are all l761-1."""
    low = F.regexp_replace(F.translate(F.lower(x), "àâäáéèêëíîïóôöúùûüç", "aaaaeeeeiiiooouuuuc"), "œ", "oe")
    dashed = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9*()]+", "-"), "^-+", ""), "-+$", "")
    return F.regexp_replace(dashed, r"^(\**)(lo|lp|l|r|d|a)-([0-9])", "$1$2$3")


def identity_key(x: Column) -> Column:
    """Loss-free identity of an article number; a leading ordinal (1er, 1ère, premier) is a plain number."""
    t = F.trim(x)
    bare = F.regexp_replace(t, r"(?i)^([0-9]+)(?:ère|ere|er)(?![\p{L}\p{N}])", "$1")
    return F.when(F.lower(t) == "premier", F.lit("1")).otherwise(article_key(bare))


def normalise_article(x: Column) -> Column:
    """A cited number in one spelling: plain dashes, no blanks around dots and dashes between digits, no trailing marks."""
    t = F.translate(F.trim(x), "‐‑‒–—−", "------")
    t = F.regexp_replace(F.regexp_replace(t, r"(?<=[0-9])\s*-\s*(?=[0-9])", "-"), r"(?<=[0-9])\s*\.\s*(?=[0-9])", ".")
    return F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"[\s.,;:)\-]+$", "")


def display_key(x: Column) -> Column:
    """l761-1 as L. 761-1; other keys as they are."""
    prefix = F.regexp_extract(x, r"^(\**)(lo|lp|l|r|d|a)[0-9]", 2)
    shown = F.concat(F.regexp_extract(x, r"^(\**)", 1), F.upper(prefix), F.lit(". "), F.regexp_replace(x, r"^\**(?:lo|lp|l|r|d|a)", ""))
    return F.when(prefix == "", x).otherwise(shown)


def clean_text(x: Column) -> Column:
    """Line breaks from br, spaces joined, at most one empty line in a row, trimmed lines."""
    t = F.regexp_replace(x, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(F.translate(t, " \u0000", " "), r"[ \t]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def strip_html(x: Column) -> Column:
    """Plain text of markup: scripts and styles go with their content, block tags end lines, other tags vanish."""
    t = F.regexp_replace(x, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", "")
    t = F.regexp_replace(t, r"(?i)</?(?:p|br|div|li|tr|h[1-6]|article|section|ul|ol|table|nav|footer)[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+$", "")


def caps_lock(x: Column, letters: int = 200, share: float = 0.85) -> Column:
    n = F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
    return (n >= letters) & (F.length(F.regexp_replace(x, r"[^\p{Lu}]", "")) >= share * n)


def snippet_head(x: Column, limit: int = 280) -> Column:
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit), F.lit("…"))).otherwise(x)


def summary_input(x: Column, limit: int = 80_000, head: int = 56_000, tail: int = 24_000) -> Column:
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, head), F.lit("\n[...]\n"), F.substring(x, -tail, tail))).otherwise(x)


def collapse_repeats(x: Column) -> Column:
    """Adjacent repeated words once."""
    return F.regexp_replace(x, r"\b(\p{L}+)(?: \1\b)+", "$1")


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^www\.", "")


def slug(x: Column, limit: int = 80) -> Column:
    """ASCII words joined by dashes, cut at a dash."""
    s = F.regexp_replace(F.regexp_replace(F.replace(F.replace(fold(x), F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae")), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    cut = F.regexp_replace(F.substring(s, 1, limit), r"-[^-]*$", "")
    return F.when(F.length(s) <= limit, s).when(F.substring(s, limit + 1, 1) == "-", F.substring(s, 1, limit)).otherwise(cut)


def usage_grams(x: Column) -> Column:
    """Words of more than one letter, then neighbours joined by an underscore."""
    words = F.filter(F.split(F.regexp_replace(F.lower(x), r"[^\p{L}-]", " "), r"\s+"), lambda w: w != "")
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws("_", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.filter(words, lambda w: F.length(w) > 1), pairs)


def trigrams(x: Column) -> Column:
    """Distinct trigrams of each word, padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


# French month names.
MONTHS = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()


def french_date(d: Column) -> Column:
    """13 février 2024; the first of a month is 1er."""
    day = F.when(F.dayofmonth(d) == 1, F.lit("1er")).otherwise(F.dayofmonth(d).cast("string"))
    return F.concat_ws(" ", day, F.element_at(F.array(*map(F.lit, MONTHS)), F.month(d)), F.year(d).cast("string"))


def parse_french_date(x: Column) -> Column:
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(x, r"(?i)^([0-9]{1,2})(?:er)? (\p{L}+) ([0-9]{4})$", 2)))
    day, year = (F.regexp_extract(x, r"(?i)^([0-9]{1,2})(?:er)? (\p{L}+) ([0-9]{4})$", k) for k in (1, 3))
    return F.when(month > 0, F.try_to_date(F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))))


def natural_key(x: Column) -> Column:
    """Sort key of an article key: rank of its prefix, its numbers, itself."""
    p = F.regexp_extract(x, r"^\**(lo|lp|l|r|d|a)?[0-9]", 1)
    rank = F.when(x.rlike("^[0-9]"), 0).when(p == "l", 1).when(p == "lo", 2).when(p == "r", 3).when(p == "d", 4).when(p == "a", 5).otherwise(6)
    return F.struct(rank.alias("part"), F.transform(F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0)), lambda n: n.cast("bigint")).alias("numbers"), x.alias("raw"))


def law_number(x: Column) -> Column:
    """Number of an act as it is cited (n° 65-557, 65 – 557): 65-557; null where no digit is left."""
    t = F.regexp_replace(F.translate(fold_nfd(x), "‑‐–—", "----"), r"^(?:numero |n° ?|no |n |num )", "")
    plain = F.regexp_replace(t, r"[\s.]", "")
    return F.when(plain.rlike("[0-9]"), plain)


def instrument_key(nature: Column, date: Column, number: Column) -> Column:
    """nature|date|number of an act; null where any of them is missing."""
    n = F.nullif(fold_nfd(nature), F.lit(""))
    return F.concat(n, F.lit("|"), F.nullif(F.trim(date), F.lit("")), F.lit("|"), law_number(number))


# Natures of texts by collection, in order of precedence.
COLLECTIONS = (
    ("codes", "CODE CONSTITUTION ETAT_CIVIL", None),
    ("textes-ue", "DIRECTIVE DIRECTIVE_EURO REGLEMENTEUROPEEN REGLEMENT_EURO DECISION_EURO AVISEURO ARRETEURO ARRETEEURO INSTRUCTIONEURO DELIBERATIONEURO DECLARATIONEURO LETTREEURO", "UE"),
    ("traites", "TRAITE TI PROTOCOLE", "INTL"),
    ("lois", "LOI LOI_ORGANIQUE LOI_CONSTIT LOI_PROGRAMME DECRET_LOI ORDONNANCE", None),
    ("decrets", "DECRET", None),
    ("arretes", "ARRETE", None),
    ("conventions-collectives", "IDCC AVENANT ACCORD ACCORD_FONCTION_PUBLIQUE", None),
    ("circulaires", "CIRCULAIRE INSTRUCTION", None),
    ("bofip", "BOFIP", None),
)
# Kinds of links between texts and their family, verb and noun alike.
LINK_VERBS = (
    "CITATION=cite MODIFIE=modifie MODIFICATION=modifie CREE=cree CREATION=cree ABROGE=abroge ABROGATION=abroge CODIFICATION=codifie CODIFIE=codifie CONCORDE=concorde "
    "CONCORDANCE=concorde TRANSFERE=transfere TRANSFERT=transfere DEPLACE=deplace DEPLACEMENT=deplace RECTIFICATION=rectifie RECTIFIE=rectifie PERIME=perime PEREMPTION=perime "
    "RATIFIE=ratifie RATIFICATION=ratifie DENONCE=denonce DENONCIATION=denonce ANNULE=annule ANNULATION=annule DISJOINT=disjoint DISJONCTION=disjoint ETEND=etend EXTENSION=etend "
    "TRANSPOSITION=transpose APPLICATION=applique"
).split()
# Names of codes, folded, and their sigles; the longest name that begins the cited one counts.
CODES = {
    "code de l entree et du sejour des etrangers et du droit d asile": "CESEDA",
    "code general des collectivites territoriales": "CGCT",
    "code general de la fonction publique": "CGFP",
    "code des relations entre le public et l administration": "CRPA",
    "code de procedure civile d execution": "CPCE",
    "code de la construction et de l habitation": "CCH",
    "code de procedure civile": "CPC",
    "code de procedure penale": "CPP",
    "code de justice administrative": "CJA",
    "code de la sante publique": "CSP",
    "code de la securite sociale": "CSS",
    "code general des impots": "CGI",
    "code de l urbanisme": "CURB",
    "code de l environnement": "CENV",
    "code de l education": "CEDU",
    "code du travail": "CT",
    "code civil": "CC",
    "code penal": "CP",
    "ceseda": "CESEDA",
    "cedh": "CEDH",
    "cgct": "CGCT",
    "cgi": "CGI",
    "cja": "CJA",
}


def collection(nature: Column, jurisdiction: Column) -> Column:
    """Collection in which a text is browsed."""
    up, out = F.upper(nature), F.lit("autres")
    for name, natures, place in reversed(COLLECTIONS):
        test = up.isin(natures.split()) | (up.startswith("CODE") if name == "codes" else F.lit(False))
        out = F.when(F.coalesce(test, F.lit(False)) | (F.coalesce(jurisdiction == place, F.lit(False)) if place else F.lit(False)), F.lit(name)).otherwise(out)
    return out


def link_verb(kind: Column) -> Column:
    """Family of a kind of link; unknown kinds in small letters."""
    known = F.create_map(*[F.lit(x) for pair in LINK_VERBS for x in pair.split("=")])
    return F.coalesce(F.try_element_at(known, kind), F.lower(kind))


def clean_summary(x: Column) -> Column:
    """A model's summary without echoed heading, place and number codes (with their preposition) and brackets of initials."""
    heading = r"^\s*\[?\s*Décision\b[^\n]*?[0-9]{4}-[0-9]{2}-[0-9]{2}[^\n]*\n+"
    code = r"[ \t]*(?:\b(?:de la|de l'|du|des|de|à la|aux|au|à|en|dans|sur|vers|chez)\s*)?\[(?:(?:Localité|Adresse|Commune|Ville)[^\]]*|[0-9][^\]]*)\]"
    t = F.regexp_replace(F.regexp_replace(x, heading, ""), "(?U)" + code, "")
    t = F.regexp_replace(t, r"\[([^\]0-9][^\]]{0,29})\]", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+([,.;:!?])", "$1"), r"[ \t]{2,}", " ")
    junk = r"^[\s,;:.–—-]+"
    plain = F.trim(F.regexp_replace(t, junk, ""))
    return F.when(t.rlike(junk) & plain.rlike(r"^\p{Ll}"), F.concat(F.upper(F.left(plain, F.lit(1))), F.substring(plain, 2, 1 << 30))).otherwise(plain)


def range_keys(first: Column, last: Column, most: int = 50) -> Column:
    """Numbers strictly between two that differ in their last part alone ("L. 225-1", "L. 225-9"); none for wider ranges."""
    cut = r"^(?:(.*)([- ]))?([0-9]+)$"
    part = lambda x, k: F.regexp_extract(x, cut, k)
    a, b = F.try_to_number(part(first, 3), F.lit("999999999")).cast("int"), F.try_to_number(part(last, 3), F.lit("999999999")).cast("int")
    fits = first.rlike(cut) & last.rlike(cut) & (part(first, 1) == part(last, 1)) & (a + 1 < b) & (b - a <= most)
    stem = F.when(part(first, 1) == "", F.lit("")).otherwise(F.concat(part(first, 1), F.lit("-")))
    return F.when(fits, F.transform(F.sequence(a + 1, b - 1), lambda n: F.concat(stem, n.cast("string")))).otherwise(F.array().cast("array<string>"))


def reference_tokens(x: Column) -> Column:
    """Tokens of cited articles, each once: L_611_1, and CSP_L_611_1 where the code that follows is known."""
    found = F.regexp_extract_all(x, F.lit(r"(?i)\b[LRDA]\s*\.\s*[0-9]{2,}(?:[-‑][0-9]+)*(?:\s+d(?:u|e la|e l['’])\s*(?:code\s+[^\n,.;:()]{3,120}|ceseda|cedh|cgct|cgi|cja))?"), F.lit(0))

    def tokens_of(m: Column) -> Column:
        number = F.regexp_replace(F.regexp_extract(m, r"([0-9]{2,}(?:[-‑][0-9]+)*)", 1), "[-‑]", "_")
        article = F.concat(F.upper(F.left(m, F.lit(1))), F.lit("_"), number)
        name = F.regexp_replace(F.translate(fold(F.regexp_extract(m, r"(?i)\s+d(?:u|e la|e l['’])\s*(.*)$", 1)), "’'`", "   "), r"\s+", " ")
        sigle = F.lit(None).cast("string")
        for start in sorted(CODES, key=len):
            sigle = F.when(name.startswith(start), F.lit(CODES[start])).otherwise(sigle)
        return F.array_compact(F.array(article, F.concat(sigle, F.lit("_"), article)))

    return F.array_distinct(F.flatten(F.transform(found, tokens_of)))


def visa_trim(x: Column, limit: int = 1705) -> Column:
    """Opening parts of a decision up to ``limit`` characters, cut at the last empty line if there is one."""
    head = F.left(x, F.lit(limit))
    cut = F.regexp_extract(head, r"(?s)^(.+)\n\n", 1)
    return F.when(F.length(x) <= limit, x).when(cut != "", cut).otherwise(head)


def expansions(query: Column, aliases: dict[str, str], most: int = 4) -> Column:
    """Long forms of the aliases that a query holds as whole words, in the order of ``aliases``, at most ``most``."""
    low = fold_nfd(query)
    held = [F.when(low.rlike(rf"(?<![\p{{L}}\p{{N}}]){alias}(?![\p{{L}}\p{{N}}])"), F.lit(long)) for alias, long in aliases.items()]
    return F.slice(F.array_distinct(F.array_compact(F.array(*held))), 1, most)


def title_query(query: Column) -> Column:
    """Words of a query as titles hold them: without "article", letters joined to the number that follows; null if none is left."""
    words = F.filter(F.split(query, r"[^\p{L}\p{N}-]+"), lambda w: (w != "") & ~F.lower(w).isin("article", "articles", "art"))
    return F.nullif(F.regexp_replace(F.array_join(words, " "), r"(?i)(?<![^ ])([lrd]) (?=[0-9])", "$1"), F.lit(""))


def separator_counts(x: Column) -> Column:
    """Number of places after each separator, by penalty, as the chunker sees them (a place at the end is none)."""
    t = F.left(x, F.length(x) - 1)
    n = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    runs = F.size(F.regexp_extract_all(t, F.lit(r"\n+"), F.lit(0)))
    return F.struct((n("\n") - runs).cast("long").alias("p0"), runs.cast("long").alias("p1"), (n(". ") / 2).cast("long").alias("p3"), n(".").cast("long").alias("p5"), n(";").cast("long").alias("p7"), n(",").cast("long").alias("p9"))
