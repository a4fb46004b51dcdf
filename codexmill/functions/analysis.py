"""Text analysis for lexical search and fact matching: normal forms, stop words, the public Snowball stemmer for Spanish."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Token pattern and stop words (fixed values).
TOKEN = r"[0-9]+(?:[.,][0-9]+)*|[a-záéíóúüñ]+"
STOP_WORDS = (
    "a al algo algunas algunos ante antes como con contra cual cuales cuando de del desde donde durante e el ella ellas ello ellos en entre era eran es esa "
    "esas ese eso esos esta estaba estado estamos estan están estar estas este esto estos fue fueron ha habia había han hasta hay la las le les lo los más mas "
    "me mi mis mucho muy nada ni no nos nosotros o os otra otras otro otros para pero poco por porque que qué quien quienes se sea ser si sí sin sobre son su "
    "sus tal también tanto te tiene tienen todo todos tu tus un una uno unos y ya yo"
).split()

#: Suffixes of the Spanish Snowball algorithm, as published (fixed values).
_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
_AFTER_ACCENT = {"iéndo": "iendo", "ándo": "ando", "ár": "ar", "ér": "er", "ír": "ir"}
_AFTER_PLAIN = ("iendo", "ando", "ar", "er", "ir")
_STANDARD = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
_STANDARD_IC = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
_REPLACED = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
_Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais "
    "iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar "
    "er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos "
    "iésemos ásemos"
).split()
_VOWELS = set("aeiouáéíóúü")


def _ends(word: str, suffixes, start: int = 0) -> str:
    """The longest of the suffixes that word ends in from place start on; '' if none."""
    tail = word[start:]
    return max((s for s in suffixes if tail.endswith(s)), key=len, default="")


def _after_vowel_pair(word: str, start: int) -> int:
    """The place after the first non-vowel that follows a vowel, from start on."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _main_region(word: str) -> int:
    if len(word) < 3:
        return len(word)
    if word[1] not in _VOWELS:
        at = next((i for i in range(2, len(word)) if word[i] in _VOWELS), None)
    elif word[0] in _VOWELS:
        at = next((i for i in range(2, len(word)) if word[i] not in _VOWELS), None)
    else:
        return 3
    return len(word) if at is None else at + 1


@cache
def _sorted_verbs() -> tuple[str, ...]:
    return tuple(sorted({*_VERBS, "en", "es", "éis", "emos"}, key=len, reverse=True))


def stem(word: str) -> str:
    """The Snowball stem of a lower-case Spanish word."""
    rv = _main_region(word)
    r1 = _after_vowel_pair(word, 0)
    r2 = _after_vowel_pair(word, r1)
    pronoun = _ends(word, _PRONOUNS, rv)
    if pronoun:
        base = word[: -len(pronoun)]
        accented, plain = _ends(base, _AFTER_ACCENT, rv), _ends(base, _AFTER_PLAIN, rv)
        if accented:
            word = base[: -len(accented)] + _AFTER_ACCENT[accented]
        elif plain or (base[rv:].endswith("yendo") and base.endswith("uyendo")):
            word = base
    short = _standard_suffix(word, r1, r2)
    if short is None:
        short = _verb_suffix(word, rv)
    return _residual(short, rv).translate(str.maketrans("áéíóú", "aeiou"))


def _standard_suffix(word: str, r1: int, r2: int) -> str | None:
    every = [*_STANDARD, *_STANDARD_IC, *_REPLACED, "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"]
    found = _ends(word, every)
    if not found:
        return None
    at = len(word) - len(found)
    base = word[:at]
    cut = lambda text, *ends: next((text[: -len(e)] for e in ends if text.endswith(e) and len(text) - len(e) >= r2), text)
    if found == "amente":
        if at < r1:
            return None
        if base.endswith("iv") and at - 2 >= r2:
            return cut(base[:-2], "at")
        return cut(base, "os", "ic", "ad")
    if at < r2:
        return None
    if found in _REPLACED:
        return base + _REPLACED[found]
    if found in _STANDARD_IC:
        return cut(base, "ic")
    if found == "mente":
        return cut(base, "ante", "able", "ible")
    if found in ("idad", "idades"):
        return cut(base, "abil", "ic", "iv")
    if found in ("iva", "ivo", "ivas", "ivos"):
        return cut(base, "at")
    return base


def _verb_suffix(word: str, rv: int) -> str:
    found = _ends(word, _Y_VERBS, rv)
    if found and word[: -len(found)].endswith("u"):
        return word[: -len(found)]
    found = next((s for s in _sorted_verbs() if word[rv:].endswith(s)), "")
    if not found:
        return word
    base = word[: -len(found)]
    return base[:-1] if found in ("en", "es", "éis", "emos") and base.endswith("gu") else base


def _residual(word: str, rv: int) -> str:
    found = _ends(word, ("os", "a", "o", "á", "í", "ó", "e", "é"), rv)
    if not found:
        return word
    base = word[: -len(found)]
    return base[:-1] if found in ("e", "é") and base.endswith("gu") and len(base) - 1 >= rv else base


@F.arrow_udf(ArrayType(StringType()))
def _stemmed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Only a batch's distinct words become Python strings; its rows stay in Arrow."""
    known: dict[str, str] = {}
    for tokens in batches:
        if len(known) > 200_000:
            known.clear()
        coded = tokens.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        for t in words:
            if t not in known:
                known[t] = t if t[0].isdigit() else stem(t)
        stems = pa.array([known[t] for t in words], pa.string()).take(coded.indices)
        ends = np.cumsum(tokens.value_lengths().fill_null(0).to_numpy())
        yield pa.ListArray.from_arrays(pa.array(np.insert(ends, 0, 0), pa.int32()), stems, mask=tokens.is_null())


#: Letters of the token alphabet that may come as a base letter and a combining mark.
_COMPOSED = {unicodedata.normalize("NFD", c): c for c in "áéíóúüñ"}


def analyze(text: Column, stop_words: bool = True, stemmed: bool = True, min_length: int = 2) -> Column:
    """Lower-cased tokens of a text in order, repeats kept; null is empty. Stop words go, then words under min_length
    letters; numbers always stay and are never stemmed. Only the stemmer leaves the JVM."""
    low = F.lower(F.coalesce(text, F.lit("")))
    for apart, one in _COMPOSED.items():
        low = F.replace(low, F.lit(apart), F.lit(one))
    found = F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))
    if stop_words:
        found = F.filter(found, lambda t: ~t.isin(*STOP_WORDS))
    found = F.filter(found, lambda t: t.rlike("^[0-9]") | (F.length(t) >= min_length))
    return _stemmed(found) if stemmed else found


def signature(stop_words: bool = True, stemmed: bool = True, min_length: int = 2) -> Column:
    """The analyzer's settings as a struct."""
    return F.struct(F.lit("es").alias("language"), F.lit(stop_words).alias("remove_stopwords"), F.lit(stemmed).alias("stem"), F.lit(min_length).alias("min_token_len"))


def _ranges(letters) -> str:
    """The letters as ranges of a character class: an engine asks a class of single letters one by one."""
    codes, out = sorted(map(ord, letters)), []
    for code in codes:
        if out and out[-1][1] == code - 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)


@cache
def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """(letters, their one-letter forms and then those without any, longer forms) of the characters that compatibility
    decomposition without combining marks changes, below the ideographs and among the presentation forms."""
    one, gone, more = {}, "", {}
    for code in (*range(0x80, 0x2E80), *range(0xFB00, 0xFFF0)):
        c = chr(code)
        form = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if form == c:
            continue
        if len(form) == 1:
            one[c] = form
        elif not form:
            gone += c
        else:
            more[c] = form
    return "".join(one) + gone, "".join(one.values()), more


def normalize_text(text: Column) -> Column:
    """Compatibility-decomposed without combining marks, lower-cased, white space collapsed and stripped; null is ''."""
    letters, forms, more = _plain_letters()
    given = F.coalesce(text, F.lit(""))
    ascii = F.octet_length(given) == F.length(given)
    plain = F.translate(given, letters, forms)
    # ASCII letters leave at the first test
    longer = F.regexp_extract_all(plain, F.lit(rf"[\x{{80}}-\x{{FFFF}}&&[{_ranges(more)}]]"), F.lit(0))
    table = F.create_map(*[F.lit(x) for pair in more.items() for x in pair])
    spread = F.aggregate(F.array_distinct(longer), plain, lambda acc, c: F.replace(acc, c, F.get(F.array(F.element_at(table, c)), F.lit(0))))
    whole = F.when(ascii, given).when(F.size(longer) > 0, spread).otherwise(plain)
    return F.regexp_replace(F.regexp_replace(F.lower(whole), r"(?U)[\s\x1c-\x1f]+", " "), "^ | $", "")
