"""Italian stems by the published Snowball steps, as SQL text over a table of words.

Each step is a table of suffixes, of which the longest counts, with the regions of
the word in which it must stand. The text is the same for every engine but for the
way a replacement names its groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Vowels, and the suffixes of each step: fixed values of the algorithm.
VOWELS = "aeiouàèìòù"
PRONOUNS = "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene"
DELETED_IN_R2 = "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti"
WITH_IC = "azione azioni atore atori"
TO_LOG = "logia logie"
TO_U = "uzione uzioni usione usioni"
TO_ENTE = "enza enze"
DELETED_IN_RV = "amento amenti imento imenti"
ADVERB = "amente"
QUALITY = "ità"
WITH_AT = "ivo ivi iva ive"
VERBS = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo "
    "Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
)


def _ends(word: str, *lists: str) -> str:
    """The longest of the suffixes that the word ends with, or an empty string: what a pattern bound to the end finds first."""
    return f"regexp_extract({word}, '(?:{'|'.join(' '.join(lists).split())})$', 0)"


def _cut(word: str, n: str) -> str:
    return f"substr({word}, 1, length({word}) - {n})"


def _one_of(value: str, *lists: str) -> str:
    return f"{value} in ({', '.join(repr(x) for x in ' '.join(lists).split())})"


def steps(group: str = "$") -> list[str]:
    """Select lists over a table with ``term``; the last gives ``term`` and ``stem``. ``group`` starts a group's name in a replacement."""
    v, c = f"[{VOWELS}]", f"[^{VOWELS}]"
    every = ", 'g'" if group == "\\" else ""
    marked = f"regexp_replace(replace(translate(term, 'áéíóú', 'àèìòù'), 'qu', 'qU'), '({v})([ui])({v})', '{group}1#{group}2{group}3'{every})"
    rv = f"length(regexp_extract(w, '^(?:{v}{c}{c}*{v}|{v}{v}{v}*{c}|{c}{c}{c}*{v}|{c}{v}.)', 0))"
    r1 = f"length(regexp_extract(w, '^{c}*{v}+{c}', 0))"
    r2 = f"length(regexp_extract(w, '^{c}*{v}+{c}{c}*{v}+{c}', 0))"
    # a region that isn't there begins behind the word
    begin = lambda n: f"case when {n} = 0 then length(w) else {n} end"
    keep = "term, rv, r1, r2"

    pronoun = f"case when s <> '' and {_ends('p', 'ando endo')} <> '' and length(p) - 4 >= rv then p when s <> '' and {_ends('p', 'ar er ir')} <> '' and length(p) - 2 >= rv then concat({_cut('p', '2')}, 'e') else w end"
    standard = " ".join(
        f"when {_one_of('s', suffixes)} and length(p) >= {region} then {then}"
        for suffixes, region, then in (
            (DELETED_IN_R2, "r2", "p"),
            (WITH_IC, "r2", "p"),
            (TO_LOG, "r2", "concat(p, 'log')"),
            (TO_U, "r2", "concat(p, 'u')"),
            (TO_ENTE, "r2", "concat(p, 'ente')"),
            (DELETED_IN_RV, "rv", "p"),
            (ADVERB, "r1", "p"),
            (QUALITY, "r2", "p"),
            (WITH_AT, "r2", "p"),
        )
    )
    # what may go with the suffix, and what may go before that, each if it stands in R2
    also = " ".join(f"when {_one_of('s', suffixes)} then {_ends('d', more)}" for suffixes, more in ((WITH_IC, "ic"), (ADVERB, "iv os ic abil"), (QUALITY, "abil ic iv"), (WITH_AT, "at")))
    further = f"case when {_one_of('s', ADVERB)} and t = 'iv' then {_ends('e', 'at')} when {_one_of('s', WITH_AT)} and t = 'at' then {_ends('e', 'ic')} else '' end"
    in_r2 = lambda word, x: f"case when {x} <> '' and length({word}) - length({x}) >= r2 then {_cut(word, f'length({x})')} else {word} end"
    return [
        f"term, replace(replace({marked}, '#u', 'U'), '#i', 'I') as w",
        f"term, w, {begin(rv)} as rv, {begin(r1)} as r1, {begin(r2)} as r2",
        f"{keep}, w, {_ends('w', PRONOUNS)} as s",
        f"{keep}, w, s, {_cut('w', 'length(s)')} as p",
        f"{keep}, {pronoun} as w",
        f"{keep}, w, {_ends('w', DELETED_IN_R2, WITH_IC, TO_LOG, TO_U, TO_ENTE, DELETED_IN_RV, ADVERB, QUALITY, WITH_AT)} as s",
        f"{keep}, w, s, {_cut('w', 'length(s)')} as p",
        f"{keep}, w, s, case {standard} else w end as d",
        f"{keep}, w, s, d, case when d = w then '' {also} else '' end as t",
        f"{keep}, w, s, d, t, {in_r2('d', 't')} as e",
        f"{keep}, w, d, e, case when e = d then '' else {further} end as u, {_ends('substr(w, rv + 1)', VERBS)} as verb",
        f"{keep}, case when d <> w then {in_r2('e', 'u')} else {_cut('w', 'length(verb)')} end as w",
        f"term, rv, case when {_ends('w', 'a e i o à è ì ò')} <> '' and length(w) - 1 >= rv then case when {_ends(_cut('w', '1'), 'i')} <> '' and length(w) - 2 >= rv then {_cut('w', '2')} else {_cut('w', '1')} end else w end as w",
        f"term, translate(case when {_ends('w', 'ch gh')} <> '' and length(w) - 2 >= rv then {_cut('w', '1')} else w end, 'IU', 'iu') as stem",
    ]


def stems(words: DataFrame) -> DataFrame:
    """term, stem of the lower-case words (term)."""
    for step in steps():
        words = words.selectExpr(*_split(step))
    return words


def stems_sql(source: str) -> str:
    """The same as a query over a table with ``term`` in a dialect that names groups with a backslash."""
    out = f"select term from {source}"
    for step in steps("\\"):
        out = f"select {step} from ({out})"
    return out


def _split(select: str) -> list[str]:
    """The expressions of a select list."""
    out, depth, quoted, at = [], 0, False, 0
    for i, x in enumerate(select):
        quoted ^= x == "'"
        depth += 0 if quoted else (x == "(") - (x == ")")
        if x == "," and not depth and not quoted:
            out.append(select[at:i])
            at = i + 1
    return [*out, select[at:]]
