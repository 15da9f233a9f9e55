"""Problem 10: template residue, filler, error pages and script notices in place of content."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from insumo.functions.text import fold, plain
from insumo.sources.shared import saved

# Delimiters of template variables. The sure ones mean nothing else; the others also have ordinary uses.
SURE = [r"\{\{\s*([\w .-]{1,40}?)\s*\}\}", r"[$#]\{\s*([\w .-]{1,40}?)\s*\}", r"<%=?\s*([\w .-]{1,40}?)\s*%>", r"%%\s*([\w .-]{1,40}?)\s*%%", r"@@\s*([\w .-]{1,40}?)\s*@@", r"\{(\d{1,2})\}"]
UNSURE = [r"\[([\p{L}_][\p{L}_ -]{1,39})\]", r"<([\p{L}_][\p{L}_ -]{1,39})>", r"\(([\p{L}_][\p{L}_ -]{1,39})\)", r"«\s*([\p{L}_][\p{L}_ -]{1,39}?)\s*»", r"\$([\p{L}_]{3,40})\$", r"__([\p{L}][\p{L}_]{1,39}?)__", r"\{([\p{L}_][\p{L}_ -]{1,39})\}", r"%([\p{L}_]{3,40})%"]
# Fixed values (folded): words that ask to fill in.
FILL_IN = ["inserir", "insira", "informar", "informe", "preencher", "preencha", "digite", "digitar", "colocar", "coloque", "complete", "completar", "rellenar", "ingrese", "insert", "enter", "fill", "your", "seu", "sua", "tbd", "todo"]
# What makes a slot one that is spoken of, not left unfilled: told to write it, called a field or variable just before, or named so just after.
WRITE, NOUN, THE = r"(?:escrev(?:a|er)|escriba|escribir|write)", r"(?:campos?|vari[aá]ve(?:l|is)|variables?|marcador(?:es)?|sintaxe|placeholders?|templates?|plantilla|fields?)", r"(?:[oa]s?|um|uma|el|la|un|una|the|an?|d[oae]s?|n[oa]s?|del)"
SLOT = "(?:" + "|".join(f"(?:{p})" for p in SURE + UNSURE) + ")"
# in 'tecnico de campo {{x}}' the word is no field, in 'o campo {{x}}' it is
GOVERNED = rf"(?i)(?:\b{WRITE}:?\s+(?:{THE}\s+)?|\b(?:modelo|template|plantilla)\b[^,:]{{0,60}},\s*{WRITE}\b[^{{$#<%@\[(«_]{{0,40}}|(?<!\bde\s)\b{NOUN}\s+)[\"'“`]?{SLOT}(?:[\"'”`]?\s*(?:,|\be\b|\bou\b|\by\b|\bo\b|\band\b|\bor\b)\s*[\"'“`]?{SLOT})*|{SLOT}[\"'”`]?\s+(?:[eé]|es|is)\s+{THE}\s+{NOUN}\b"
# Fixed values (folded): default texts of empty slots, words of nonsense Latin, and messages that stand instead of a page.
DEFAULTS = ["insira seu texto", "insira o texto aqui", "descricao do produto vai aqui", "texto de exemplo", "texto vai aqui", "conteudo em breve", "em construcao", "teste teste", "texto aqui", "conteudo aqui", "sample text", "your text here", "text goes here", "content coming soon", "coming soon", "texto de ejemplo", "inserte su texto", "contenido en breve", "lorem ipsum", "bla bla", "asdf qwer", "asdf asdf", "xxxxx", "aaa bbb ccc", "click to edit", "n/a"]
LATIN = ["lorem", "ipsum"]
STATUS = r"(?:40[0-9]|410|418|429|50[0-4])"
ERRORS = [
    rf"^(?:http|erro|error|codigo|status)?\s*{STATUS}\b.{{0,80}}$",
    r"(?:pagina|page|endereco|recurso|url).{0,25}(?:nao (?:foi )?encontrad|nao existe|not found|no encontrad|no existe)", r"^(?:ops|oops|ups)\b", r"\bnot found\b", r"\b(?:bad gateway|internal server error|service unavailable|gateway time-?out|forbidden|access denied|unauthorized|request blocked)\b",
    r"\b(?:acesso negado|acesso restrito|acceso (?:denegado|restringido)|nao tem permissao|no tiene permiso|sin permiso)\b", r"\b(?:sessao expirada|sesion (?:expirada|caducada)|session expired)\b", r"\b(?:algo deu errado|algo salio mal|something went wrong|ocorreu um erro|se produjo un error|an error occurred)\b",
    r"\b(?:nao foi possivel (?:carregar|exibir|concluir)|no se pudo (?:cargar|mostrar)|could not (?:load|be loaded)|failed to load|falha ao (?:consultar|carregar|conectar))\b", r"\b(?:erro interno|error interno|temporariamente indisponivel|temporalmente no disponible|tempo limite excedido|timeout)\b", r"^traceback\b", r"\bnullreference\b|\bnullpointerexception\b|\bundefined index\b|\bfatal error\b|\bstack trace\b",
]
SCRIPTS = [r"\b(?:ative|ativar|habilite|habilitar|active|activar|enable|turn on|permita|ligue)\b.{0,25}\b(?:javascript|scripts?)\b", r"\b(?:precisa de|requer|requires?|necesita|needs)\b.{0,15}\bjavascript\b", r"\b(?:nao executa|no ejecuta|does not (?:run|support)|bloqueados?|desativados?|disabled)\b.{0,20}\bscripts?\b|\bscripts? (?:bloqueados?|desativados?|disabled|blocked)\b|\bjavascript (?:is )?(?:disabled|desativado|desabilitado)\b"]
# Fixed values (folded): a piece of every message above but those that begin with a status or a cry.
TROUBLE = ["erro", "falha", "fail", "negad", "denied", "denegado", "bloque", "blocked", "script", "indisponivel", "disponible", "expir", "caducada", "traceback", "nullpointer", "nullreference", "undefined index", "stack trace", "encontrad", "nao existe", "no existe", "not found", "bad gateway", "unavailable", "time-out", "timeout", "forbidden", "unauthorized", "acesso restrito", "acceso restringido", "nao tem permissao", "no tiene permiso", "sin permiso", "algo deu", "algo salio", "went wrong", "se produjo", "nao foi possivel", "no se pudo", "could not", "tempo limite"]
#: Words of a whole short page; words of a message; words from which a closed sentence is prose; a slot's default stands alone in at most so many words.
PAGE_WORDS, MESSAGE_WORDS, PROSE_WORDS, SLOT_WORDS = 30, 14, 6, 12
#: A filler part repeats a unit of at most so many words; share of the part that it covers at least.
UNIT_WORDS, COVERED = 6, 0.8
#: Records that fill a slot at least, and records of a page template at least.
FILLED, REPEATED = 3, 3
# A bare name in capitals (NUM_PEDIDO); a blank where a word belongs (two between words, or one before a sign); a label without value.
BARE = r"(?<![\p{L}\p{N}_])\p{Lu}+(?:_\p{Lu}+)+(?![\p{L}\p{N}_])"
BLANK = r"(?<=\p{L}) {2,}(?=\p{L})|(?<=\p{L}) (?=[.,;!?](?:\s|$))"
LABEL = r"(?m)^\s*[\p{L} ]{2,30}:\s*[_.\-…]*\s*$"
OPEN = r"(?=[{$#<%@\[(«_])"
GAP = "⟦⟧"


def _sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n+|(?<=[.!?;])\s+"), F.trim), lambda s: s != "")


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+)"), 1)


def _lines(text: Column) -> Column:
    """Text with plain line breaks."""
    return F.regexp_replace(text, r"[ \t]*\n\s*", "\n")


_WORD = r"[a-z0-9_]+(?: ?[:-](?=\s))?|\n|[^\sa-z0-9_]"
PLACE, WORD = 0, 1


def _tokens(text: Column) -> Column:
    """Words (with the colon or dash of a label), signs and line breaks of a text, lower case and with figures masked, a line break at either
    end; a slot with its delimiters, a bare name and a blank are one token each, as they stand."""
    whole = rf"{OPEN}{SLOT}|{BARE}|{GAP}"
    found = F.regexp_extract_all(text, F.lit(rf"{whole}|[\p{{L}}\p{{N}}_]+(?: ?[:-](?=\s))?|\n|[^\s\p{{L}}\p{{N}}_]"), 0)
    found = F.transform(found, lambda t: F.when(t.rlike(rf"^(?:{whole})$"), t).otherwise(F.regexp_replace(fold(t), r"\d+", "0")))
    return F.concat(F.array(F.lit("\n")), found, F.array(F.lit("\n")))


def _hashes(words: pd.Series | list[str]) -> np.ndarray:
    return pd.util.hash_array(np.asarray(words, dtype=object), categorize=False)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint64(0x9E3779B97F4A7C15) ^ (b >> np.uint64(29)) ^ b << np.uint64(35)).view(np.int64)


@F.pandas_udf(LongType())
def _frame(before: pd.Series, behind: pd.Series) -> pd.Series:
    """A number for what stands before and behind a place."""
    return pd.Series(_pair(_hashes(before), _hashes(behind)))


@F.pandas_udf(LongType())
def _word_key(word: pd.Series) -> pd.Series:
    return pd.Series(_hashes(word).view(np.int64))


def _held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """what (PLACE, WORD), key, value, n: for every place of one or two tokens its frame and a number of what fills it; for each word of a part
    (between blank lines) its number. Texts come folded."""
    token, lines, figures, parts, word = re.compile(_WORD), re.compile(r"[ \t]*\n\s*"), re.compile(r"\d+"), re.compile(r"\n\s*\n"), re.compile(r"[^\W_]+")
    for batch in batches:
        flat, words = ["\n", "\n", "\n"], Counter()
        for text in batch["text"]:
            flat += token.findall(figures.sub("0", lines.sub("\n", text)))
            flat += ("\n", "\n", "\n")
            for part in parts.split(text):
                words.update(set(word.findall(part)))
        codes, distinct = pd.factorize(np.asarray(flat, dtype=object))
        h = _hashes(distinct)[codes]
        at = np.arange(1, len(h) - 2)
        one, two = _pair(h[at - 1], h[at + 1]), _pair(h[at - 1], h[at + 2])
        yield pd.DataFrame({"what": PLACE, "key": np.concatenate([one, two]), "value": np.concatenate([h[at].view(np.int64), _pair(h[at], h[at + 1])]), "n": 1})
        yield pd.DataFrame({"what": WORD, "key": _hashes(list(words)).view(np.int64), "value": 0, "n": list(words.values())})


def _scan(docs: DataFrame) -> DataFrame:
    """doc_id, kind, text, h: all that the documents themselves show, in one pass: texts that hold slots (`slots`), parts of nonsense Latin
    (`latin`), pages that may be of an error template (`page`, h its masked template), and what needs no more (`blank`, `filler`, `message`)."""
    text, low = F.col("text"), F.col("low")
    row = lambda kind, text=F.lit(None).cast("string"), h=F.lit(None).cast("long"): F.struct(F.lit(kind).alias("kind"), text.alias("text"), h.alias("h"))
    none = F.array().cast("array<struct<kind:string,text:string,h:bigint>>")
    only = lambda cond, rows: F.when(cond, rows).otherwise(none)
    blanks = F.when(F.contains(text, F.lit("  ")) | text.rlike(r" [.,;!?](?:\s|$)"), text.rlike(rf"(?:{BLANK})[^\n]*?(?:{BLANK})")).otherwise(False)
    slots = only(text.rlike(rf"{OPEN}{SLOT}") | F.contains(text, F.lit("_")) & text.rlike(BARE) | blanks, F.array(row("slots", text)))
    lines = F.filter(F.split(text, r"\n+"), lambda x: F.trim(x) != "")
    labels = F.filter(lines, lambda x: x.rlike(LABEL))
    blank = only(text.rlike(LABEL), F.filter(F.array(F.when((F.size(labels) >= 2) & (F.size(labels) >= 0.7 * F.size(lines)), row("blank"))), lambda x: x.isNotNull()))
    # parts are between blank lines
    default = "|".join(_pattern(d) for d in DEFAULTS)

    def filler(p: Column) -> Column:
        w, n = p["w"], F.size(p["w"])
        cover = lambda k: F.size(F.filter(F.sequence(F.lit(0), n - 1 - k), lambda i: F.get(w, i) == F.get(w, i + k))) + k
        periodic = F.greatest(*(F.when(n >= 3 * k, cover(k) / n).otherwise(0.0) for k in range(1, UNIT_WORDS + 1)))
        # figures repeat in lists; a unit has letters
        repeated = (n >= 3) & (F.size(F.array_distinct(w)) <= 0.5 * n) & F.exists(w, lambda x: x.rlike(r"^\p{L}+$")) & (periodic >= COVERED)
        return repeated | (n <= SLOT_WORDS) & fold(p["part"]).rlike(rf"^\W*(?:titulo\W+)?(?:{default})\W*$")

    parts = F.transform(F.split(F.lower(text), r"\n\s*\n"), lambda p: F.struct(p.alias("part"), _words(p).alias("w")))
    latin = lambda p: F.arrays_overlap(p["w"], F.array(*map(F.lit, LATIN)))
    of_parts = F.filter(F.transform(parts, lambda p: F.when(filler(p), row("filler")).when(latin(p), row("latin", p["part"]))), lambda x: x.isNotNull())
    # messages: a short sentence that is one, in a page with no other prose; and pages of a repeated template
    known = "|".join(f"(?:{p})" for p in ERRORS + SCRIPTS)
    ss = F.transform(_sentences(low), lambda x: F.struct(x.alias("s"), F.size(_words(x)).alias("n"), (x.rlike(known) & (F.size(_words(x)) <= MESSAGE_WORDS)).alias("known")))
    prose = F.exists("ss", lambda x: ~x["known"] & (x["n"] >= PROSE_WORDS) & x["s"].rlike(r"[.!?;]$"))
    short = F.size(_words(low)) <= PAGE_WORDS
    message = F.exists("ss", lambda x: x["known"]) & (short | ~prose)
    masked = F.array_join(F.transform("ss", lambda x: F.regexp_replace(x["s"], r"0x[0-9a-f]+|\w*\d\w*", "0")), "|")
    page = F.exists("ss", lambda x: x["known"]) | F.forall("ss", lambda x: x["n"] <= 12)
    # texts without any of the messages' words have no sentences taken apart
    trouble = F.exists(F.array(*map(F.lit, TROUBLE)), lambda t: F.contains(low, t)) | low.rlike(rf"(?:^|\n|[.!?;]\s)\s*(?:(?:http|codigo|status)?\s*{STATUS}|o?ops|ups)\b")
    of_page = only(F.size("ss") > 0, F.filter(F.array(F.when(message, row("message")), F.when(page, row("page", h=F.xxhash64(masked)))), lambda x: x.isNotNull()))
    # a generated column is computed once; a projected one would be again in every use
    one = docs.select("doc_id", F.explode(F.array(F.struct("text", fold(F.col("text")).alias("low")))).alias("t")).select("doc_id", "t.*")
    one = one.select("doc_id", "text", "low", F.explode(F.array(F.when(trouble, ss).otherwise(F.array().cast("array<struct<s:string,n:int,known:boolean>>")))).alias("ss"))
    return one.select("doc_id", F.explode(F.concat(slots, blank, of_parts, of_page)).alias("x")).select("doc_id", "x.*")


def _slots(texts: DataFrame) -> DataFrame:
    """doc_id, token, frame, name, shape (sure, unsure, bare, blank), asks of the slots in texts (doc_id, text), but for those that a
    sentence only speaks of (GOVERNED)."""
    blanks = lambda x: F.size(F.regexp_extract_all(x, F.lit(BLANK), 0))
    # text set with double spaces throughout has no blanks
    habit = lambda x: x.rlike(r"(?:\S+ {2,}){4}")
    gapped = F.array_join(F.transform(F.split(_lines(F.regexp_replace(plain(F.col("text")), GOVERNED, " ")), "\n"), lambda x: F.when((blanks(x) >= 2) & ~habit(x), F.regexp_replace(x, BLANK, f" {GAP} ")).otherwise(x)), "\n")
    w = texts.select("doc_id", F.explode(F.array(_tokens(gapped))).alias("w"))
    slot = rf"^(?:{SLOT}|{BARE}|{GAP})$"
    at = F.transform("w", lambda t, i: F.when(t.rlike(slot), F.struct(t.alias("token"), F.get("w", i - 1).alias("before"), F.get("w", i + 1).alias("behind"))))
    found = w.select("doc_id", F.explode(F.filter(at, lambda x: x.isNotNull())).alias("x")).select("doc_id", "x.token", _frame("x.before", "x.behind").alias("frame"))
    folded = lambda c: F.trim(F.regexp_replace(fold(c), r"[\s_.-]+", " "))
    inner = lambda ps: F.array_max(F.array(*(F.regexp_extract("token", f"^{p}$", 1) for p in ps)))
    found = found.select("*", F.explode(F.array(F.struct(inner(SURE).alias("sure"), inner(UNSURE).alias("unsure")))).alias("y"))
    shape = F.when(F.col("token") == GAP, "blank").when(F.col("y.sure") != "", "sure").when(F.col("y.unsure") != "", "unsure").otherwise("bare")
    found = found.select("doc_id", "token", "frame", F.explode(F.array(F.struct(shape.alias("shape"), folded(F.greatest("y.sure", "y.unsure", F.when(F.col("token").rlike("^\\w"), F.col("token")).otherwise(""))).alias("name")))).alias("z")).select("doc_id", "token", "frame", "z.*")
    verb = r"^(?:" + "|".join(FILL_IN) + r")\b"
    # a request's own words aren't part of the name: <inserir data entrega>
    found = found.withColumn("asks", F.col("name").rlike(verb) & F.col("shape").isin("sure", "unsure"))
    return found.withColumn("name", F.when(F.col("asks"), F.trim(F.regexp_replace("name", verb + r"(?: (?:o|a|os|as|seu|sua|the|your))?\b", ""))).otherwise(F.col("name"))).filter("name <> '' or asks or shape = 'blank'")


def residue(docs: DataFrame) -> DataFrame:
    """doc_id, kind (slot, blank, filler, message) of documents that are, or have in a content part, such residue.

    Records of one template are aligned by what stands about a place: the tokens before and behind it (a label counts with its
    colon). A place that at least FILLED records fill with different text, of one or two words, is a slot. A slot keeps its
    variable's name if the name stands in delimiters that mean nothing else; or, in an induced slot, in other delimiters and in
    capitals, or bare in capitals (NUM_PEDIDO); or if it is a variable's name of the corpus in any delimiter, or asks to fill in.
    It is blank if two places of a text that others fill are empty. Whole-page labels without values, texts that repeat a short unit or a
    default, and nonsense Latin (its vocabulary counted over all documents) are filler. A page is a message if a short sentence is
    a known one and the page, of any length, has no other prose; or if its masked template is that of REPEATED documents and it holds a known message or
    only short sentences with a word of error.

    docs: doc_id, text. Null and empty texts are no residue; a repeated row counts once. Documents are read twice: once for all marks, once
    for what other records hold in the marked places and how often the marked words occur. Texts go nowhere whole but those with slots."""
    docs = docs.select("doc_id", "text").filter("text is not null and text <> ''")
    marks = saved(_scan(docs).distinct(), "marks")
    slots = saved(_slots(marks.filter("kind = 'slots'")), "slots")
    seeded = saved(marks.filter("kind = 'latin'").select("doc_id", F.xxhash64("text").alias("part"), F.explode(_words(F.col("text"))).alias("word")).withColumn("key", _word_key(fold(F.col("word")))), "latin")
    wanted = slots.filter("not asks").select(F.lit(PLACE).alias("what"), F.col("frame").alias("key")).union(seeded.select(F.lit(WORD), "key")).distinct()
    # second pass: fillers of the wanted places, and parts with the wanted words
    held = docs.select(fold(F.col("text")).alias("text")).mapInPandas(_held, "what int, key long, value long, n long").join(wanted, ["what", "key"], "left_semi")
    held = saved(held.groupBy("what", "key").agg(F.sum("n").alias("n"), F.min("value").alias("least"), F.max("value").alias("most")), "held")

    filled = held.filter((F.col("what") == PLACE) & (F.col("n") >= FILLED) & (F.col("least") != F.col("most"))).select(F.col("key").alias("frame"), F.lit(True).alias("slot"))
    slots = slots.join(filled, "frame", "left").withColumn("slot", F.coalesce("slot", F.lit(False)))
    variables = slots.filter("shape = 'sure' or asks").select("name").distinct().withColumn("variable", F.lit(True))
    slots = slots.join(variables, "name", "left")
    capitals = F.col("token").rlike(r"\p{Lu}{2}") & ~F.col("token").rlike(r"\p{Ll}|^\(")
    named = slots.filter(F.col("asks") | (F.col("shape") == "sure") | F.coalesce("variable", F.lit(False)) & (F.col("shape") != "blank") | F.col("slot") & (F.col("shape").isin("unsure", "bare")) & capitals).select("doc_id", F.lit("slot").alias("kind"))
    empty = slots.filter("shape = 'blank' and slot").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n >= 2").select("doc_id", F.lit("blank").alias("kind"))

    with_seed = seeded.select("doc_id", "part", "key", "word").distinct().groupBy("key").agg(F.count("*").alias("with_seed"), F.max(F.col("word").isin(*LATIN)).alias("seed"))
    vocabulary = with_seed.join(held.filter(F.col("what") == WORD), "key").filter((F.col("with_seed") >= 2) & (F.col("with_seed") >= 0.8 * F.col("n")) | F.col("seed")).select("key", F.lit(1).alias("latin"))
    latin = seeded.join(vocabulary, "key", "left").groupBy("doc_id", "part").agg(F.count("*").alias("n"), F.sum(F.coalesce("latin", F.lit(0))).alias("k")).filter("n >= 5 and k >= 0.6 * n").select("doc_id", F.lit("filler").alias("kind"))

    pages = marks.filter("kind = 'page'")
    repeated = pages.join(pages.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= REPEATED), "h", "left_semi").select("doc_id", F.lit("message").alias("kind"))
    sure = marks.filter("kind in ('blank', 'filler', 'message')").select("doc_id", "kind")
    return sure.unionByName(named).unionByName(empty).unionByName(latin).unionByName(repeated).distinct()


def _pattern(text: str) -> str:
    return text.replace("/", r"\W?").replace(" ", r"\W+")
