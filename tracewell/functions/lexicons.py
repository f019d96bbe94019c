"""German word lists of the method (fixed values, stated as they are)."""

from __future__ import annotations


def words(text: str) -> frozenset[str]:
    return frozenset(text.split())


# fixed values: abbreviations before which a full stop ends no sentence
ABBREVIATIONS = words(
    "z.b bzw ca dr prof mio mrd nr u.a d.h o.ä o.a vgl ggf inkl evtl usw str abs art etc sog u.u v.a bspw geb st hr fr min max tel co jh jhd s"
)
# fixed values: words without content
FUNCTION_WORDS = words(
    """der die das den dem des ein eine einen einem einer eines und oder in an auf zu von mit für bei nach vor aus seit über
    unter um durch gegen ist sind war waren sein wird werden wurde wurden hat haben habe hatte hätte sich als auch noch nur
    schon dann dass wenn dort hier man es er sie ihr ihm ihn mehr sehr viel etwa rund dabei damit diese dieser dieses jenes
    solche soll sollen sollte kann können könnte muss müssen sei seien wäre werde im am beim zum zur vom ins dessen deren
    welche welcher welches so wie daher also zwar eben gar ja doch denn insgesamt circa cirka ungefähr knapp jeweils
    bereits zunächst derzeit aktuell überdies ebenfalls zudem außerdem ferner vorerst weiterhin erneut wiederum allerdings
    womöglich offenbar angeblich möglicherweise voraussichtlich schließlich nunmehr immerhin durchaus ohnehin lediglich
    nämlich vielmehr indes hingegen zumal obendrein sogar selbst nochmals abermals demnach mithin folglich"""
)
# fixed values: connectives that open a claim of their own
CONNECTIVES = words(
    """deshalb deswegen daher darum somit folglich infolgedessen weshalb außerdem zudem ferner ebenso gleichzeitig zugleich
    aber doch jedoch allerdings dennoch trotzdem stattdessen hingegen wohingegen sondern während weil da obwohl obgleich wenngleich"""
)
# fixed values
AFTER_UND = words("zwar das dies damit dabei dann so")
# fixed values
AFTER_NEGATION = words("weil sondern denn da")
# fixed values
NEGATIONS = words("nicht nichts kein keine keinen keinem keiner keines nie niemals keineswegs nirgends weder")
# fixed values
PREPOSITIONS = words(
    """unter über mit ohne für von bei nach vor aus seit trotz wegen in an auf zu im am beim zum zur gegen um durch neben
    zwischen statt samt laut gemäß entlang innerhalb"""
)
# fixed values
ANAPHORA = words(
    """sie ihn ihm ihr ihnen ihre ihrer ihres ihrem er es dies diese dieser dieses diesem diesen dabei dadurch damit dafür
    davon daran darauf deren dessen derselbe dieselbe letzterer letztere"""
)
# fixed values: number words
ONES = "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn".split()
TENS = "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split()
ARTICLES = words("ein eine einen einem einer eines")
# fixed values
SCALES = {"million": 6, "millionen": 6, "mio": 6, "milliarde": 9, "milliarden": 9, "mrd": 9, "tausend": 3, "tsd": 3}
MONEY = words("euro euros eur €")
PERCENT = words("prozent %")
# fixed values
UNITS = {
    "jährig": "Jahre", "jahr": "Jahre", "jahre": "Jahre", "jahren": "Jahre", "tägig": "Tage", "stündig": "Stunden",
    "minütig": "Minuten", "monatig": "Monate", "wöchig": "Wochen", "monat": "Monate", "tag": "Tage", "stunde": "Stunden",
    "woche": "Wochen", "hektar": "Hektar", "köpfig": "Personen", "stellig": "Stellen", "stöckig": "Stockwerke",
    "spurig": "Spuren", "teilig": "Teile", "prozentig": "%",
}
# fixed values
ADJECTIVE_ENDINGS = ("er", "es", "en", "em", "e", "")
# fixed values: names
TITLES = words(
    """dr prof herr frau professor professorin oberbürgermeister oberbürgermeisterin bürgermeister bürgermeisterin kämmerer
    kämmerin minister ministerin senator senatorin landrat landrätin fraktionschef fraktionschefin sprecher sprecherin
    geschäftsführer geschäftsführerin vorstand vorsitzender vorsitzende trainer trainerin kanzler kanzlerin präsident
    präsidentin intendant intendantin"""
)
NAME_STARTS_NOT = words(
    """der die das den dem des ein eine einen einem einer eines im am beim zum zur und mit nach vor für von bei aus trotz
    neben während wegen über unter ohne gegen seit bis durch auch aber diese dieser dieses alle seine ihre sein ihr neue
    neuer neues als wie dass"""
)
NO_NAMES = words(
    """million millionen milliarde milliarden tausend euro prozent komma uhr stimmen jahr jahre jahren osten westen norden
    süden stadt gemeinde land bund regierung regierungen partei parteien rat haushalt januar februar märz april mai juni
    juli august september oktober november dezember montag dienstag mittwoch donnerstag freitag samstag sonntag morgen
    abend gefahr vergleich höhe sanierung"""
)
# fixed values
ENDINGS = words("e en n s es er ern em ns in innen nen ung ungen um a as os us") | {""}
# fixed values
DERIVATIONS = words("er ner ler aner ianer isch ische ischer ischen isches sche scher schen")
# fixed values
NEGATION_PATTERN = r"\b(nicht|nichts|kein\w*|nie|niemals|niemand|ohne|weder|kaum|nirgend\w*|aufgehoben|abgesagt|gestrichen)\b"
# fixed values: words that are no finite verb between a quotation and its speaker
NO_VERBS = words(
    """der die das den dem des ein eine einen einem einer eines welche welcher welches dessen deren sein seine ihr ihre diese
    dieser dieses und oder aber doch jedoch sondern also zwar denn wenn weil dass ob als wie wo während obwohl damit sobald
    nachdem bevor falls in im an am auf für mit von vom bei beim nach über unter vor seit bis durch ohne gegen um zu zur zum
    aus neben trotz nicht auch noch schon nur sehr immer dort hier dann darum deshalb dabei etwa rund"""
)
# fixed values: the flags that labels name
FLAGS = (
    "zahlkonflikt zahl_unbelegt ort_konflikt kuerzel_konflikt ident_unbelegt wortlaut_abweichung widerspruch_wortgleich bedeutung_verschoben nli_widerspruch"
).split()
