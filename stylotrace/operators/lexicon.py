"""Word lists and suffix rules of the built-in annotator.

A stated proxy for a parser: closed-class words per language, then endings. The tables are data of
this package and can be replaced by the caller.
"""

from __future__ import annotations

CLOSED_CLASS = {
    "en": {
        "DET": "the a an this that these those",
        "PRON": "i you he she it we they who which",
        "ADP": "of in to for on with at by from",
        "CCONJ": "and or but",
        "SCONJ": "if because while",
        "AUX": "is are was were be been being has have had will would can",
        "PART": "not",
    },
    "de": {
        "DET": "der die das den dem ein eine einen",
        "PRON": "ich du er sie es wir",
        "ADP": "in von zu mit auf für bei",
        "CCONJ": "und oder aber",
        "SCONJ": "dass weil wenn",
        "AUX": "ist sind war waren wird werden wurde wurden hat haben",
        "PART": "nicht",
    },
    "fr": {
        "DET": "le la les un une des du",
        "PRON": "je tu il elle nous vous ils qui",
        "ADP": "de à en dans pour sur avec par",
        "CCONJ": "et ou mais",
        "SCONJ": "que si",
        "AUX": "est sont était été être a ont",
        "PART": "ne pas",
    },
    "es": {
        "DET": "el la los las un una",
        "PRON": "yo él ella nosotros ellos quien",
        "ADP": "de a en para por con sobre",
        "CCONJ": "y o pero",
        "SCONJ": "que si porque",
        "AUX": "es son era fue fueron ser ha han",
        "PART": "no",
    },
    "ru": {
        "PRON": "я ты он она мы вы они это",
        "ADP": "в на с по из к от для",
        "CCONJ": "и или но а",
        "SCONJ": "что если",
        "AUX": "был была было были будет",
        "PART": "не",
    },
}

# Forms of "be" that make a following participle passive.
BE_FORMS = {
    "en": "is are was were be been being",
    "de": "wird werden wurde wurden",
    "fr": "est sont était été être",
    "es": "es son era fue fueron ser",
    "ru": "был была было были будет",
}

# (language, part of speech, pattern over the lower-cased word); the first match decides.
SUFFIX_RULES = [
    ("en", "ADV", "ly$"),
    ("en", "VERB", "(ing|ed|ize|ise|ify)$"),
    ("en", "ADJ", "(ous|ful|able|ible|ive|al|ic|less)$"),
    ("de", "ADJ", "(lich|ig|isch|bar|sam)$"),
    ("de", "VERB", "(ieren|eln|ern|te|ten|en)$"),
    ("fr", "ADV", "ment$"),
    ("fr", "VERB", "(er|ir|ait|aient|ant|ée?s?)$"),
    ("fr", "ADJ", "(eux|euse|ique|able|ible|ifs?|ives?)$"),
    ("es", "ADV", "mente$"),
    ("es", "VERB", "(ar|er|ir|ando|iendo|ad[oa]s?|id[oa]s?)$"),
    ("es", "ADJ", "(os[oa]s?|able|ible|ic[oa]s?)$"),
    ("ru", "VERB", "(ть|ться|ет|ит|ют|ал|ил|ла|ли|лось|лся)$"),
    ("ru", "ADJ", "(ый|ий|ой|ая|ое|ые|ого|ных)$"),
]

# (language, verb form, pattern) over verbs.
VERB_FORM_RULES = [
    ("en", "Part", "(ing|ed)$"),
    ("de", "Part", "^ge.+(t|en)$"),
    ("fr", "Part", "(ant|ée?s?)$"),
    ("es", "Conv", "(ando|iendo)$"),
    ("es", "Part", "(ad[oa]s?|id[oa]s?)$"),
    ("ru", "Conv", "(вши|вшись|учи)$"),
    ("ru", "Part", "(вший|щий|нный|мый)$"),
]

# Participles that do not count as passive after a form of "be".
ACTIVE_PARTICIPLE = {"en": "ing$", "fr": "ant$"}

CONTENT_POS = ["NOUN", "VERB", "ADJ", "ADV", "NUM"]
TERMINATORS = [".", "!", "?"]


def lexicon_rows(lexicon: dict = CLOSED_CLASS) -> list[tuple[str, str, str, bool]]:
    """(language, word, part of speech, is a form of "be"), one row per word and language."""
    rows = []
    for lang, classes in lexicon.items():
        be = BE_FORMS.get(lang, "").split()
        seen = set()
        for upos, words in classes.items():
            for w in words.split():
                if w not in seen:
                    seen.add(w)
                    rows.append((lang, w, upos, w in be))
    return rows
