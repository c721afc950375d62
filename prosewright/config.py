"""The language registry: alphabets, tags, clitics, linking elements and layers of each language."""

from __future__ import annotations

import string
from dataclasses import dataclass

UNKNOWN, SENT_START, SENT_END = "UNKNOWN", "SENT_START", "SENT_END"


def ascii_lower(s: str) -> str:
    """Lower-cases A-Z and nothing else."""
    return s.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


@dataclass(frozen=True)
class Lang:
    code: str
    name: str
    digit_tag: str
    punct_tag: str
    name_tag: str
    alphabet: str
    spell_message: str
    punctuation: str = ".,;:…!?"
    clitics: tuple[str, ...] = ()
    links: tuple[str, ...] = ()
    strip_marks: bool = False
    confusion: bool = True
    neural: bool = False


#: All that follows must equal what rule packs and dictionaries of these languages use.
PUNCTUATION = ".,;:…!?"
#: Class tags that English adds to punctuation.
EN_CLASSES = {",": ",", ".": ".", "!": ".", "?": ".", "…": ".", ":": ":", ";": ":"}
LATIN = "abcdefghijklmnopqrstuvwxyz"
EN = Lang("en", "english", digit_tag="CD", punct_tag="PCT", name_tag="NNP", alphabet="abcdefghijklmnopqrstuvwxyz", spell_message="Possible spelling mistake found.", neural=True)
DE = Lang(
    "de", "german", digit_tag="ZAN", punct_tag="PKT", name_tag="EIG:NOM:SIN:MAS", alphabet="abcdefghijklmnopqrstuvwxyz", spell_message="Möglicher Tippfehler gefunden.",
    links=("s", "es", "n", "en", "er", "e", "ens", "ns"),
)
RU = Lang("ru", "russian", digit_tag="NumC:Nom", punct_tag="PNCT", name_tag="NN:Name:Masc:Sin:Nom", alphabet="абвгдеёжзийклмнопрстуфхцчшщъыьэюя", spell_message="Возможно найдена орфографическая ошибка.")
AR = Lang(
    "ar", "arabic", digit_tag="CD", punct_tag="PCT", name_tag="NA-;-1U-;---", alphabet="ءآأؤإئابةتثجحخدذرزسشصضطظعغـفقكلمنهوىي", spell_message="وُجد خطأ إملائي محتمل",
    punctuation=".,;:…!?،؛؟", strip_marks=True, confusion=False,
)
FR = Lang(
    "fr", "french", digit_tag="Y", punct_tag="M", name_tag="Z", alphabet="abcdefghijklmnopqrstuvwxyzàâçéèêëîïôûùüÿœæ", spell_message="Faute de frappe possible trouvée.",
    clitics=("l'", "d'", "j'", "m'", "t'", "s'", "n'", "c'", "ç'", "qu'", "jusqu'", "lorsqu'", "puisqu'", "quoiqu'", "quelqu'"),
)
ES = Lang("es", "spanish", digit_tag="Z", punct_tag="_PUNCT", name_tag="NP00000", alphabet="abcdefghijklmnopqrstuvwxyzáéíóúüñ", spell_message="Se ha encontrado un posible error ortográfico.")
IT = Lang(
    "it", "italian", digit_tag="DET-NUM-CARD", punct_tag="PON", name_tag="NPR", alphabet="abcdefghijklmnopqrstuvwxyzàèéìîïòóùú", spell_message="Trovato un probabile errore di battitura.",
    clitics=("l'", "un'", "dell'", "all'", "nell'", "sull'", "dall'", "coll'", "quest'", "quell'", "c'", "d'", "n'", "v'", "m'", "t'", "s'", "anch'", "gliel'", "sant'", "bell'", "grand'"),
    confusion=False,
)
#: End of the fixed values.
LANGS = {x.code: x for x in (EN, DE, RU, AR, FR, ES, IT)}
#: Function words that end in a full stop without ending a sentence. Chosen by hand.
ABBREVIATIONS = ("dr", "mr", "mrs", "prof", "st", "vs", "etc", "bzw", "usw", "nr", "sr", "sra", "mme", "fig", "no")


def artifact(code: str, kind: str, folder: str = "resources") -> str:
    """Where a language's table of a kind lies (FN-10)."""
    return f"{folder}/{code}/{kind}"


def jar_url(group: str, name: str, version: str) -> str:
    """Where the public repository of Java packages has a dictionary's jar (FN-10)."""
    return f"https://repo1.maven.org/maven2/{group.replace('.', '/')}/{name}/{version}/{name}-{version}.jar"
