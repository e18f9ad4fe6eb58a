"""Journal names abbreviated word by word after the public list of title word abbreviations."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Title words and their short forms; an empty one means that the word is left out.
WORDS = {
    "a": "", "an": "", "and": "", "at": "", "by": "", "for": "", "from": "", "in": "", "of": "", "on": "", "the": "", "to": "", "with": "",
    "der": "", "die": "", "das": "", "und": "", "für": "", "de": "", "la": "", "le": "", "les": "", "du": "", "des": "", "et": "", "el": "", "y": "",
    "academy": "Acad.", "abstracts": "Abstr.", "advances": "Adv.", "africa": "Afr.", "annals": "Ann.", "annual": "Annu.", "applications": "Appl.", "applied": "Appl.",
    "archives": "Arch.", "association": "Assoc.", "bulletin": "Bull.", "bureau": "Bur.", "communications": "Commun.", "computer": "Comput.", "computing": "Comput.",
    "conference": "Conf.", "current": "Curr.", "department": "Dep.", "digest": "Dig.", "discussions": "Discuss.", "education": "Educ.", "engineering": "Eng.",
    "european": "Eur.", "experimental": "Exp.", "federation": "Fed.", "gazette": "Gaz.", "general": "Gen.", "health": "Health", "history": "Hist.", "industry": "Ind.",
    "industrial": "Ind.", "information": "Inf.", "institute": "Inst.", "international": "Int.", "journal": "J.", "laboratory": "Lab.", "letters": "Lett.",
    "library": "Libr.", "magazine": "Mag.", "management": "Manag.", "material": "Mater.", "materials": "Mater.", "modern": "Mod.", "monographs": "Monogr.",
    "national": "Natl.", "nature": "Nat.", "natural": "Nat.", "new": "New", "newsletter": "Newsl.", "nuclear": "Nucl.", "physical": "Phys.", "proceedings": "Proc.",
    "progress": "Prog.", "quarterly": "Q.", "record": "Rec.", "records": "Rec.", "report": "Rep.", "reports": "Rep.", "research": "Res.", "resources": "Resour.",
    "review": "Rev.", "reviews": "Rev.", "royal": "R.", "science": "Sci.", "sciences": "Sci.", "scientific": "Sci.", "series": "Ser.", "social": "Soc.", "society": "Soc.",
    "studies": "Stud.", "surveys": "Surv.", "symposium": "Symp.", "systems": "Syst.", "technical": "Tech.", "theoretical": "Theor.", "theory": "Theory",
    "transactions": "Trans.", "university": "Univ.", "world": "World",
}
#: Beginnings of title words and the short forms of all words that begin so.
STEMS = {
    "agricultur": "Agric.", "algebra": "Algebr.", "america": "Am.", "analy": "Anal.", "anthropolog": "Anthropol.", "archaeolog": "Archaeol.", "astronom": "Astron.",
    "astrophys": "Astrophys.", "australi": "Aust.", "behavio": "Behav.", "biochem": "Biochem.", "biolog": "Biol.", "biophys": "Biophys.", "botan": "Bot.", "brit": "Br.",
    "canad": "Can.", "chem": "Chem.", "climat": "Clim.", "clinic": "Clin.", "comparativ": "Comp.", "conserv": "Conserv.", "deutsch": "Dtsch.", "ecolog": "Ecol.",
    "econom": "Econ.", "electr": "Electr.", "environment": "Environ.", "ethnolog": "Ethnol.", "evolution": "Evol.", "geograph": "Geogr.", "geolog": "Geol.",
    "geophys": "Geophys.", "hydrolog": "Hydrol.", "immunolog": "Immunol.", "linguist": "Linguist.", "literatur": "Lit.", "marin": "Mar.", "mathemat": "Math.",
    "mechani": "Mech.", "medic": "Med.", "metallurg": "Metall.", "meteorolog": "Meteorol.", "microbiolog": "Microbiol.", "mineral": "Mineral.", "molecul": "Mol.",
    "neurolog": "Neurol.", "oceanograph": "Oceanogr.", "palaeontolog": "Palaeontol.", "patholog": "Pathol.", "pharmac": "Pharm.", "philosoph": "Philos.",
    "physic": "Phys.", "physiolog": "Physiol.", "politic": "Polit.", "psycholog": "Psychol.", "sociolog": "Sociol.", "statist": "Stat.", "technolog": "Technol.",
    "zoolog": "Zool.",
}


def abbreviation(journal: Column) -> Column:
    """A name with each listed word shortened and articles, joining words and prepositions left out; other words stay. NULL stays NULL."""
    tables = {id(t): F.from_json(F.lit(json.dumps(t)), "map<string,string>") for t in (WORDS, STEMS)}
    pick = lambda table, key: F.try_element_at(tables[id(table)], key)

    def word(w: Column) -> Column:
        low = F.regexp_replace(F.lower(w), r"[^\p{L}]+", "")
        # Of the beginnings that fit, the longest says most.
        lengths = sorted({len(s) for s in STEMS}, reverse=True)
        stem = reduce(lambda found, n: F.coalesce(found, pick(STEMS, F.substring(low, 1, n))), lengths, F.lit(None).cast("string"))
        return F.coalesce(pick(WORDS, low), stem, w)

    return F.array_join(F.filter(F.transform(F.split(F.trim(journal), r"(?U)\s+"), word), lambda w: w != ""), " ")
