"""Rule lists of the cleaning steps. Rules are values: nothing changes them at run time."""

from __future__ import annotations

# Patterns deleted from every text segment, in this order.
MARKUP = (
    r"<from.*?>.*?</from>",
    r"""<(?:"[^"]*"['"]*|'[^']*'['"]*|[^'">])+>""",
    r"^@.*\{.*\}",
    r"^\..*\{.*\}",
    r"\s\s+",
    r"\n",
    r"\x{a0}",
    r"dbx707",
    r"\x{e2}",
    r"\x{80}",
    r"\x{8b}",
    r"\{\{\.*\}\}",
    r"\x{9d}",
    r"\x{200b}",
)
TAG_RULE = MARKUP[1]

# Patterns deleted from every lower-case word, by kind.
URL = (
    # a top-level domain must end at a word boundary: before a non-word character, the end, or after a bracket
    r"^https?://(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.(?:"
    r"[äöüßa-zA-Z0-9()]{0,5}[äöüßa-zA-Z0-9](?:$|[-()@:%\+.~#?&/=][-a-zäöüßA-Z0-9()@:%_\+.~#?&/=]*$)"
    r"|[äöüßa-zA-Z0-9()]{0,5}[()][a-zäöüßA-Z0-9_][-a-zäöüßA-Z0-9()@:%_\+.~#?&/=]*$)",
    r"www\w*de",
    r"www\w*com",
)
EMAIL = (r"^\S+@\S+\.\S+$",)
ZIP = (r"^[0-9]{5}(?:-[0-9]{4})?\s?\w*$",)
PHONE = (r"^\+?[1-9][0-9]{7,14}$",)
DATES = (
    r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
    r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$",
    r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$",
)
NUMBERS = (r"^\d+$", r"^\s?[0-9]+(\s+[0-9]+)*\s?$", r"\(.*\)", r"\[.*\]", r"^\d+.\d+", r" \d+ ")
SPECIAL = (r"[^äöüßA-Za-z0-9 ]+",)
WEBSITES = (
    "explore", "allgemeine geschäftsbedingungen", "general terms and conditions", r"allgemein\*",
    r"richtlinie\w*", r"guideline\w*", r"\w*recht\w* hinweis\w*", r"\w*recht\w*", r"\w*datenschutz\w*",
    "data privacy", "privacy", r"policy\w*", r"cooky\w*", r"cookie\w*", r"content\w*", r"anmeld\w*",
    r"abmeld\w*", "login", "log in", "logout", "log out", "kunden login", "customer login", "online",
    "zurück", "back", "start", r"select\w*", r"ausw\w*", "close", r"extra\w*", "news", r"report\w*",
    "impressum", r"newsletter\w*", "owner", "internet", r"website\w*", r"email\w*", r"e-mail\w*",
    r"mail\w*", "isbn", "issn", "produkte", "products", "partner", "übersicht", "overview",
    "veranstaltungen", r"suche\w*", r"kauf\w*", r"angebot\w*", r"konfigur\w*", r"configur\w*",
    r"nutzer\w*", r"icon\w*", "zubehör", "garantie", "mehr", r"modell\w*", r"kontakt\w*",
    r"contact\w*", r"anfrage\w*", "skip", "useful links", r"link\w*", r"passw\w*", r"password\w*",
    "buchen", "book", "anfahrt", "directory", r"finanzdienstleistung\w*", r"financial servic\w*",
    "connected", "required", r"sitemap\w*", r"\w*\s?abo\w*", "social media", "socialmedia", "englisch",
    "english", "deutsch", "german", "google", "wikipedia", "navigation", r"\w*shop\w*",
    r"\w*magazin\w*", "lifestyle", r"facebook\w*", r"youtube\w*", r"instagram\w*", r"xing\w*",
    r"linkedin\w*", r"blog\w*", r"spiegel\w*", r"twitter\w*", "sms", "video", r"archiv\w*",
    r"artikel\w*", r"article\w*", r"side\w*", r"seite\w*", "site", r"app\w*",
    r"\s?abgerufen\s?\w*\s*\d*", r"\s?retrieved\s?\w*\s*\d*", "januar", "februar", "märz", "april",
    "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember", "january",
    "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
    "december", "dbx707", "db11", r"\w*\s?straße\s?\d*", r"\w*\s?strasse\w*", r"tel\w*",
    r"\w*\s?download\w*", r"covid\w*\s?\d*", r"corona\w*\s?\d*", r"\w*\s?street\s?\d*",
)
DOMAIN = (
    "(g/km)", r"use case\w*", r"unternehme\w*", "gmbh", "cokg", "co kg", r"consult\w*", r"handel\w*",
    r"händler\w*", r"leistung\w*",
)
SHORT = (r"^\w{0,3}$", r"^\s+")

# Neighbours that the older rule list joined into one pattern each.
FUSED = (("book", "anfahrt"), ("video", r"archiv\w*"), (r"\s?retrieved\s?\w*\s*\d*", "januar"))


def website_rules(compat: bool = False) -> tuple[str, ...]:
    """Website rules; ``compat`` joins the three fused neighbours as the older list did."""
    if not compat:
        return WEBSITES
    out = list(WEBSITES)
    for first, second in FUSED:
        at = out.index(first)
        out[at : at + 2] = [first + second]
    return tuple(out)


def word_rules(compat: bool = False) -> tuple[str, ...]:
    """All word rules in the order in which they are applied."""
    return URL + EMAIL + ZIP + PHONE + DATES + NUMBERS + SPECIAL + website_rules(compat) + DOMAIN + SHORT


# Patterns that disqualify a search hit.
RESULT_BLACKLIST = (
    "google", "googleadservices", "home.mobile", "autoscout24", "web2.cylex", "servicesinfo", "11880",
    "wikipedia", "accessor", "hotel", "musical", "boutique", "bafa", "media", "photo", "foto", "file",
    "europa.eu", "order", "gewinnspiel", "conditions", "terms", "legal", "subscription", "abonn", "cooky",
    "cookie", "policy", "rechtlich", "privacy", "datenschutz", "suche", "formular", "pdf", "foerderland",
    "umweltbundesamt", "ihk", "capital", "marketing", "billiger", "instagram", "spotify", "deezer", "shop",
    "github", "vimeo", "apple", "twitter", "facebook", "whatsapp", "tiktok", "pinterest", "klarna", "jobs",
    "linkedin", "xing", "mozilla", "youtube", "store", "update",
)

# Substrings that disqualify a page link.
LINK_BLACKLIST = (
    "wikipedia", "bundesregierung", "accessor", "hotel", "musical", "boutique", "bafa", "media", "photo",
    "foto", "file", "europa.eu", "order", "gewinnspiel", "conditions", "terms", "legal", "subscription",
    "abonn", "cooky", "cookie", "policy", "rechtlich", "privacy", "datenschutz", "suche", "formular", "pdf",
    "foerderland", "umweltbundesamt", "ihk", "capital", "marketing", "billiger", "instagram", "spotify",
    "deezer", "shop", "github", "vimeo", "apple", "twitter", "facebook", "twitch", "google", "whatsapp",
    "tiktok", "pinterest", "klarna", "jobs", "linkedin", "xing", "mozilla", "youtube", "gebrauchtwagen",
    "neufahrzeug", "neuwagen", "garage", "rent", "impressum", "imprint", "masthead", "newsletter", "kontakt",
    "contact", "karriere", "career", "login", "termin", "store", "update", "adbk", "sky",
    "betriebsanleitung", "manual", "kununu", "wissen.de", "gutschein", "geo.de", "linguee", "mouser.de",
)

# Journals, and the words that let a link to a journal pass.
JOURNALS = ("spiegel", "sueddeutsche", "handelsblatt", "faz", "welt.de")
JOURNAL_TOPICS = ("auto", "car", "mobilitaet", "mobilität", "mobility", "motor")

# Markers of a page that could not be read.
BLOCKED_MARKERS = ("javascript", "java script", "denied")
