"""Fixed patterns of the text-healing operators.

All are written for both regular expression engines in use (no look-around).
"""

# Repository boilerplate, captions, line noise, document tails, citations, routing terms, abbreviations.
BOILERPLATE = (
    r"(?i)(To\s+cite\s+this\s+version|HAL\s+Id\s*:|hal\.science|HAL\s+is\s+a\s+multi.disciplinary|archive\s+ouverte\s+pluridisciplinaire|Submitted\s+on\s+\d+|"
    r"Distributed\s+under\s+a\s+Creative\s+Commons|tin[ée]e?\s+au\s+d[eé]p[oô]t|⟨hal-\d+|⟨10\.\d{4,})"
)
CAPTION = r"(?i)^\s*(fig\.?|figure)\s+[0-9]+"
NOISE = (
    r"(?i)^(copyright\s*©.*|©\s*.+|ISBN\s*.*|ISSN\s*.*|[\d\-\s]{5,20}|(author|designer|editor|production\s*editor|cover\s*image)\s*[\t ]*.*|an\s+esa\s+production|"
    r"(credit|image|photo|source|spacecraft)\s*:.*|\(?(ESA|NASA|JPL|ATG\s*medialab)[/&,;\s\w()]*\)?\s*|[\w\s]+\((ESA|NASA|JPL)[/&,;\s\w()]*\)(,\s*[\w\s]+\([/&,;\s\w()]*\))*\s*|"
    r".{3,60}[\t ]{2,}\d{1,3}\s*|\d{1,4}\s*|Page\s+\d+(\s+of\s+\d+)?\s*|\d{1,4}\s+Page\s+\d+\s+of\s+\d+\s*|Publisher.s\s+Note\s+.*|"
    r"Open\s+Access\s+This\s+article\s+is\s+licensed\s+under.*|(article.s\s+)?Creative\s+Commons\s+licen[sc]e.*|(To\s+view\s+a\s+copy\s+of\s+this\s+licen[sc]e|you\s+will\s+need\s+to\s+obtain).*|"
    r"(not\s+included\s+in\s+the\s+article.s|regulation\s+or\s+exceeds).*|Extended\s+author\s+information\s+available.*|https?://doi\.org/.*)$"
)
DOC_CODE = r"^[A-Z]{2,4}[-/]\d{2,4}"
TAIL = r"(?m)^#{1,3}\s*(References|Authors?\s+and\s+Affiliations?|Declarations?)\s*$"
SOURCES_TAIL = r"(?is)\n*##?\s*Sources.*"
ROUTE = r"(?i)\b(NORAD\s*ID|TLE|inclination|apoapsis|periapsis|eccentricity|orbital\s+period|semi.?major\s+axis|how\s+many\s+satellites|list\s+all\s+satellites|satellite\s+catalog)\b"
ABBREVIATIONS = tuple("Fig fig Figs figs e.g i.e etc al Dr Mr Ms Prof No Vol vs Eq eq approx cf Ref ref Sect sect Ch ch Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec Inc Corp Ltd".split())
BULLETS = ("•", "–", "-", "*", "+")
#: English words that no search looks for.
STOP_WORDS = frozenset(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further "
    "had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves "
    "out over own s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where "
    "which while who whom why will with you your yours yourself yourselves".split()
)
