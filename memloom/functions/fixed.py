"""Word lists, names and patterns that must equal the documented behaviour for right results. Fixed values, in natural order."""

# Fact types.
FACT_TYPES = ("personal", "preference", "professional", "project", "relationship", "world", "general")

# Valence levels.
VALENCES = {-2: "very_negative", -1: "negative", 0: "neutral", 1: "positive", 2: "very_positive"}

# Stop words of the similarity tokenizer.
STOP_WORDS = tuple(
    """the a an is are was were be been being have has had do does did will would could should may might must shall can to of in for
    on with at by from as into through during before after above below between under again further then once here there when where
    why how all each few more most other some such no nor not only own same so than too very just and but if or because until while
    this that these those i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom""".split()
)

# Keywords of the topic categories; on equal counts the earlier category wins.
TOPICS = {
    "technical": "code python javascript api database bug error function class programming debug deploy server algorithm data software development testing git docker kubernetes linux web app framework".split(),
    "creative": "story novel character plot chapter write writing fiction fantasy narrative scene dialogue draft manuscript outline worldbuilding lore magic hero villain romance adventure poetry creative".split(),
    "personal": "feel feeling stressed happy sad worried excited relationship friend family work career life health hobby goal plan decision advice help".split(),
    "general": "question explain how what why learn understand help information know think idea opinion".split(),
}

# Emotion keywords of one word, in the order that breaks ties, with each emotion's valence.
EMOTIONS = {
    "joy": (1, "happy glad joyful excited thrilled delighted pleased cheerful elated wonderful fantastic amazing awesome great love loving loved enjoy enjoying enjoyed fun laugh laughing smile smiling yay woohoo hooray brilliant excellent perfect beautiful grateful thankful".split()),
    "sadness": (-1, "sad unhappy depressed down blue miserable heartbroken devastated upset disappointed sorry regret miss missing lonely alone grief mourning cry crying tears weep melancholy gloomy hopeless despair hurt hurting pain".split()),
    "anger": (-1, "angry mad furious enraged irritated annoyed frustrated pissed hate hatred resent resentful outraged livid hostile bitter rage fury damn hell stupid idiot ridiculous unfair".split()),
    "fear": (-1, "afraid scared frightened terrified anxious worried nervous panic dread horror alarmed uneasy apprehensive fearful phobia terror scary creepy threatening danger dangerous".split()),
    "surprise": (0, "surprised shocked amazed astonished stunned unexpected wow omg whoa incredible unbelievable remarkable extraordinary speechless astounding".split()),
    "trust": (1, "trust believe faith confident sure certain reliable dependable honest sincere loyal faithful trustworthy genuine authentic".split()),
    "anticipation": (1, "excited eager anticipate expect hope hoping waiting upcoming soon planning plan future tomorrow next".split()),
}

# Markers of fact quality.
HIGH_VALUE = ("my name", "i live", "i moved", "i grew up", "i work", "my job", "i speak", "i study", "i own", "i drive")
TRANSIENT = (
    "i'm debugging", "i'm trying to", "i'm getting an error", "i'm testing", "i'm looking at", "i'm reading", "i'm stuck on", "i'm confused about",
    "i need help with", "i'm running", "i just ran", "i'm checking", "i'm writing a test", "i'm fixing", "i'm updating",
)
CODE_LIKE = ("()", "=>", "def ", "class ", "import ", "{", "}", "```")
GENERIC = ("i have a question", "i need help", "i want to know", "i am trying")

# Agent names by user agent, first match wins.
USER_AGENTS = (("blackreach", "blackreach"), ("open.?webui", "open-webui"), (r"continue\.dev", "continue"), ("cursor", "cursor"), ("python-httpx", "python-script"), ("python-requests", "python-script"))

# Negations and opposites of the contradiction rule.
NEGATIONS = ("not", "no", "never", "don't", "doesn't", "didn't", "isn't", "aren't", "wasn't", "weren't", "won't", "can't", "cannot", "hardly", "rarely", "seldom")
OPPOSITES = (
    ("like", "dislike"), ("likes", "dislikes"), ("love", "hate"), ("loves", "hates"), ("enjoy", "avoid"), ("enjoys", "avoids"), ("prefer", "reject"), ("prefers", "rejects"),
    ("support", "oppose"), ("supports", "opposes"), ("agree", "disagree"), ("agrees", "disagrees"), ("happy", "unhappy"), ("happy", "sad"), ("good", "bad"), ("best", "worst"),
    ("always", "never"), ("true", "false"), ("yes", "no"), ("start", "stop"), ("started", "stopped"), ("begin", "end"), ("began", "ended"), ("buy", "sell"), ("bought", "sold"),
    ("join", "leave"), ("joined", "left"), ("accept", "decline"), ("accepted", "declined"), ("increase", "decrease"), ("increased", "decreased"),
)

# Synonym groups of themes, the default of a parameter: each term stands for the others of its group. A choice, not a full list.
SYNONYMS = (
    ("death", "mortality", "afterlife", "underworld"), ("creation", "origin", "genesis", "cosmogony"), ("flood", "deluge", "cataclysm"), ("trickster", "shapeshifter", "deceiver"),
    ("hero", "champion", "warrior"), ("prophecy", "oracle", "divination", "seer"), ("sacrifice", "offering", "immolation"), ("fate", "destiny", "wyrd", "moira"),
    ("rebirth", "resurrection", "reincarnation", "renewal"), ("chaos", "void", "abyss", "primordial"), ("sacred", "holy", "divine", "hallowed"), ("quest", "journey", "pilgrimage", "odyssey"),
    ("dragon", "serpent", "wyrm"), ("magic", "sorcery", "witchcraft", "enchantment"), ("spirit", "ghost", "phantom", "shade"),
)

# Patterns of facts in what users say: type, subtype, whether a name is asked for, pattern (case-blind but for names).
FACT_PATTERNS = (
    ("personal", "name", True, r"(?:my name is|i am|i'm)\s+(?-i:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"),
    ("personal", "age", False, r"(?:i am|i'm)\s+(\d{1,3})\s*(?:years? old|yo)"),
    ("personal", "location", True, r"(?:i live in|i'm from|i'm in|based in)\s+(?-i:[A-Z][a-zA-Z]+(?:[\s,]+[A-Z]?[a-zA-Z]+)*)"),
    ("personal", "occupation", False, r"(?:i work (?:as|at)|i'm a|my job is)\s+(?:a\s+)?([^.!?,]+?)(?:\.|,|!|\?|$)"),
    ("personal", "family", False, r"(?:i have|i've got)\s+(\d+)\s+(kids?|children|sons?|daughters?|pets?|cats?|dogs?)"),
    ("personal", "experience", False, r"(?:i've been|i have been)\s+([^.]+?)\s+for\s+(\d+\s*(?:years?|months?|days?))"),
    ("preference", "like", False, r"(?:i (?:really )?(?:like|love|enjoy|prefer))\s+([^.!?,]{3,50})(?:\.|,|!|\?|$)"),
    ("preference", "favorite", False, r"(?:my favorite[s]? (?:is|are))\s+([^.!?,]{3,50})(?:\.|,|!|\?|$)"),
    ("preference", "favorite", False, r"(?:i'm (?:a fan of|into|passionate about))\s+([^.!?,]{3,50})(?:\.|,|!|\?|$)"),
    ("preference", "dislike", False, r"(?:i (?:don't|do not|never) (?:like|enjoy))\s+([^.!?,]{3,50})(?:\.|,|!|\?|$)"),
    ("preference", "dislike", False, r"(?:i hate|i dislike|i can't stand)\s+([^.!?,]{3,50})(?:\.|,|!|\?|$)"),
    ("project", "current_project", False, r"(?:i'm (?:working on|building|creating|developing))\s+([^.!?,]{3,60})(?:\.|,|!|\?|$)"),
    ("project", "project_name", False, r"(?:my (?:project|app|site|book|novel|story) (?:is called|is))\s+([^.!?,]{3,40})(?:\.|,|!|\?|$)"),
    ("project", "goal", False, r"(?:i'm trying to|i want to|my goal is to)\s+([^.!?,]{3,60})(?:\.|,|!|\?|$)"),
    ("relationship", "partner", True, r"(?:my (?:wife|husband|partner|girlfriend|boyfriend|spouse)(?:'s name is|,?\s+))(?-i:[A-Z][a-z]+)"),
    ("relationship", "partner", True, r"(?:my (?:wife|husband|partner|girlfriend|boyfriend|spouse))\s+(?-i:[A-Z][a-z]+)"),
    ("relationship", "friend", True, r"(?:my (?:friend|best friend|colleague))\s+(?-i:[A-Z][a-z]+)"),
    ("relationship", "family_member", True, r"(?:my (?:mom|dad|mother|father|sister|brother|parent)(?:'s name is|,?\s+))(?-i:[A-Z][a-z]+)"),
)

# Pairs of words of which a new fact and a known one must not hold one each.
CONTRARIES = (
    ("like", "dislike"), ("love", "hate"), ("prefer", "avoid"), ("enjoy", "dislike"), ("can", "cannot"), ("is", "is not"), ("has", "has no"),
    ("want", "don't want"), ("happy", "unhappy"), ("works at", "left"), ("lives in", "moved from"),
)
# Attributes that have one value, attributes that have several, and beginnings of values that are no values.
SINGULAR = ("name", "age", "location", "occupation", "partner")
SEVERAL = ("like", "dislike", "prefer", "enjoy", "want", "need", "favorite", "interest", "hobby", "skill", "goal", "project", "topic", "friend", "relationship")
NO_VALUES = ("the", "is", "are", "not", "just", "still", "being", "doing")

# Words of time, and what marks the past and the present.
TIME_WORDS = (
    "before", "after", "then", "later", "earlier", "previously", "recently", "now", "currently", "formerly", "originally", "used to", "started", "stopped", "began", "ended",
    "first", "next", "finally", "eventually", "since", "until", "yesterday", "today", "tomorrow", "last year", "this year", "in 2020", "in 2021", "in 2022", "in 2023", "in 2024", "in 2025", "in 2026",
)
PAST = r"\b(used to|formerly|previously|originally|was|were|had been|stopped|quit|gave up|moved from|left)\b"
PRESENT = r"\b(currently|now|is|are|has been|recently started|lives in|works at|works as)\b"

# What marks a telling sentence of a summary, and a project of fiction.
SUMMARY_MARKERS = ("the user", "they expressed", "demonstrated", "interested in", "working on", "asked about")
FICTION_WORDS = ("my character", "in the story", "my protagonist", "wizard", "dragon", "mana", "spell", "dungeon", "elves", "orcs", "magic", "quest", "tavern")

# Words that summaries pass over.
FILLER_WORDS = tuple(
    """the a an is are was were be been being have has had do does did will would could should may might must shall can to of in for on with at by
    from as into through during before after above below between under again further then once here there when where why how all each few more
    most other some such no nor not only own same so than too very just also now i you he she it we they me him her us them my your his its our
    their this that these those am and but or if because while although though even what""".split()
)
# Names of technologies, and patterns of places, persons, projects and dates (case-blind); words that are no names.
TECHNOLOGIES = (
    "python javascript typescript java rust go golang c++ c# ruby php swift kotlin scala react vue angular django flask fastapi express nodejs docker kubernetes k8s aws azure gcp linux windows macos "
    "postgresql mysql mongodb redis sqlite git github gitlab vscode vim emacs pytorch tensorflow numpy pandas chromadb openai claude anthropic llm gpt transformer embedding api rest graphql"
).split()
_NAME, _NAMES = "[a-z]+", r"[a-z]+(?:\s+[a-z]+)?"
ENTITY_PATTERNS = (
    ("location", rf"\bin\s+({_NAMES})\b"), ("location", rf"\bat\s+({_NAMES})\b"), ("location", rf"\bfrom\s+({_NAMES})\b"), ("location", rf"\blive[ds]?\s+in\s+({_NAMES})\b"), ("location", rf"\bbased\s+in\s+({_NAMES})\b"),
    ("person", rf"\bmy\s+(?:friend|wife|husband|partner|colleague)\s+({_NAME})\b"), ("person", rf"\bname\s+is\s+({_NAMES})\b"), ("person", rf"\bi'?m\s+({_NAME})\b"), ("person", rf"\bcall\s+me\s+({_NAME})\b"),
    ("project", rf"\bproject\s+({_NAMES})\b"), ("project", rf"\b({_NAMES})\s+project\b"), ("project", rf"\bapp\s+called\s+({_NAMES})\b"), ("project", rf"\bbuilding\s+({_NAMES})\b"),
    ("date", r"\b(\d{4}-\d{2}-\d{2})\b"), ("date", r"\b(\d{1,2}/\d{1,2}/\d{2,4})\b"), ("date", r"\b((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2}(?:st|nd|rd|th)?(?:,?\s+\d{4})?)\b"),
    ("date", r"\b(last\s+(?:week|month|year))\b"), ("date", r"\b(yesterday|today|tomorrow)\b"),
)
NO_NAMES = (
    "The This That These Those What Which Where When Why How Hello Hi Thanks Please Sure Yes No Maybe But And Or If So Just Actually Really Very Also Then Now Here There Always Never Sometimes Often Usually"
).split()
# Intents of a conversation by patterns, the first of equals wins; how a summary of each begins.
INTENTS = (
    ("question", (r"\?$", r"^(?:how|what|why|when|where|who|can|could|would|is|are|do|does)\b")), ("task", (r"\b(?:build|create|implement|write|add|fix|update|change|modify)\b",)),
    ("learning", (r"\b(?:learn|understand|explain|study|explore|research)\b",)), ("problem", (r"\b(?:error|bug|issue|problem|fail|broken|wrong)\b",)),
)
SUMMARY_BEGINNINGS = {"discussion": "Discussed", "question": "User asked about", "task": "Worked on", "learning": "Explored", "problem": "Addressed issue with"}
# What makes a sentence weigh more, and what is cut from it.
TELLING = (
    (r"\b(important|key|main|crucial|essential|critical)\b", 0.15), (r"\b(conclusion|summary|result|finding|outcome)\b", 0.15), (r"\b(decided|concluded|determined|found|discovered)\b", 0.1),
    (r"\b(should|must|need to|have to|requires)\b", 0.08), (r"\b(because|therefore|thus|hence|consequently)\b", 0.08),
)
CUTS = (
    (r"\bI think (that )?(.*)", 2), (r"\bbasically,?\s*", 0), (r"\bso,?\s*", 0), (r"\bactually,?\s*", 0), (r"\bjust\s+", 0), (r"\breally\s+", 0), (r"\bkind of\s+", 0), (r"\bsort of\s+", 0),
    (r"\byou know,?\s*", 0), (r"\bI mean,?\s*", 0), (r"\blike,?\s+", 0),
)
