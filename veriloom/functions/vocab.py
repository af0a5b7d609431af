"""Word lists that must equal the documented behaviour."""

ARTICLES = "the a an".split()
HONORIFICS = "dr mr mrs ms miss prof sir madam".split()
CORP_SUFFIXES = (
    "corporation incorporated corp inc ltd limited llc plc co company pvt private holdings group gmbh sarl pty services systems"
).split()
DROPPED_TYPES = "CARDINAL ORDINAL QUANTITY PERCENT DATE TIME MONEY".split()
DROPPED_PREDICATES = "be have do get exist".split()
GENERIC_PHRASES = [
    "all names",
    "real customers",
    "financial transactions",
    "fictional",
    "classification synthetic",
    "all identifiers",
    "amounts and events",
]
RESOLVER_STOPWORDS = "the a an of and in on for to its it is at by".split()
GENERIC_SINGLETONS = (
    "bank company center centre university hospital court group team study paper system department agency firm "
    "corporation association institute school ministry committee board report project program"
).split()
QUESTION_STOPWORDS = (
    "the a an of and in on for to is are was were what which who whom where when why how does do did tell about me give list show"
).split()
ENDPOINT_STOPWORDS = "the a an it this that these those he she they we you i its their his her them him".split()
MONTHS = "January February March April May June July August September October November December".split()

# White space as Unicode text tools see it (regex engines differ on \s).
SPACE_CHARS = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0" + "".join(
    map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# Characters that leave no mark on paper.
INVISIBLE_CHARS = "".join(
    map(
        chr,
        [
            0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F),
            *range(0x2060, 0x2065), *range(0x2066, 0x206A), 0xFE0E, 0xFE0F, 0xFEFF,
        ],
    )
)
EDGE_CHARS = "\"'()[]{}.,;:!?"

# Identifier families a demonstrative noun ("this loan") may stand for ([0-9] and [A-Za-z0-9_] because \d and \w differ between engines).
CODE_FAMILIES = {
    "account": "(?:SA|CA)[0-9]+",
    "loan": "LN[0-9]+",
    "batch": "(?:PO|NCR)[-0-9][A-Za-z0-9_-]*",
    "case": "CS[-0-9][A-Za-z0-9_-]*",
    "report": "(?:NCR|CAPA)[-0-9][A-Za-z0-9_-]*",
    "action": "(?:CAPA|NCR)[-0-9][A-Za-z0-9_-]*",
    "machine": "(?:RG|LS)-[A-Z]+-[0-9]+",
    "equipment": "(?:RG|LS)-[A-Z]+-[0-9]+",
    "branch": "BR[0-9]+",
    "customer": "CUST[0-9]+",
    "transaction": "TXN[0-9]+",
    "order": "PO[-0-9][A-Za-z0-9_-]*",
    "motor": "(?:LS|RG)-[A-Z]+-[0-9]+",
}
# Nouns that end a job title.
TITLE_NOUNS = (
    "lead manager director officer engineer technician planner head chief supervisor coordinator administrator "
    "analyst consultant specialist president chairman secretary partner associate assistant clerk"
).split()
# What switches a setting off.
OFF_WORDS = ("false", "0", "no")
