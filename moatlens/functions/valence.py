"""Data of our own for polarity scoring, and the published constants of its rules."""

# Own illustrative values on the usual -4..+4 scale; not a copy of any published lexicon.
VALENCE = [
    ("good", 1.9), ("great", 3.1), ("best", 3.2), ("love", 3.2), ("excellent", 3.4), ("happy", 2.7), ("free", 1.0), ("win", 2.8), ("strong", 2.3), ("growth", 1.6),
    ("amazing", 3.0), ("awesome", 3.1), ("better", 1.8), ("brilliant", 2.8), ("clean", 1.4), ("clear", 1.4), ("easy", 1.9), ("efficient", 1.8), ("enjoy", 2.2), ("fair", 1.3),
    ("fantastic", 2.9), ("fast", 1.6), ("favorite", 2.1), ("friendly", 2.2), ("gain", 1.8), ("glad", 2.0), ("helpful", 2.0), ("helps", 1.6), ("impressive", 2.4), ("improve", 1.8),
    ("improved", 1.9), ("improvement", 1.8), ("intuitive", 1.9), ("like", 1.5), ("loved", 3.0), ("loves", 3.0), ("nice", 1.8), ("outstanding", 3.0), ("perfect", 3.0), ("pleasant", 2.1),
    ("pleased", 2.0), ("positive", 2.0), ("powerful", 1.9), ("profit", 1.8), ("recommend", 1.9), ("reliable", 2.0), ("reward", 2.0), ("robust", 1.6), ("safe", 1.7), ("satisfied", 2.0),
    ("simple", 1.2), ("smooth", 1.7), ("solid", 1.5), ("stable", 1.4), ("success", 2.5), ("successful", 2.5), ("superb", 3.0), ("trust", 2.0), ("useful", 1.9), ("valuable", 2.1),
    ("value", 1.3), ("winner", 2.6), ("works", 1.0), ("worth", 1.4),
    ("bad", -2.5), ("worst", -3.1), ("hate", -2.7), ("poor", -2.1), ("sad", -2.1), ("loss", -1.3), ("risk", -1.1), ("weak", -1.9), ("fail", -2.5), ("lawsuit", -2.0),
    ("angry", -2.3), ("annoying", -2.0), ("awful", -2.9), ("broken", -1.9), ("bug", -1.4), ("buggy", -1.9), ("bugs", -1.4), ("burden", -1.6), ("cancel", -1.0), ("clunky", -1.6),
    ("complaint", -1.6), ("complicated", -1.3), ("confusing", -1.6), ("costly", -1.3), ("crash", -2.0), ("crashes", -2.0), ("crashed", -2.0), ("cumbersome", -1.5), ("decline", -1.4),
    ("delay", -1.3), ("delays", -1.3), ("difficult", -1.4), ("disappointed", -2.1), ("disappointing", -2.2), ("doubt", -1.4), ("error", -1.5), ("errors", -1.5), ("expensive", -1.4),
    ("failed", -2.3), ("failure", -2.4), ("fear", -2.0), ("fraud", -2.9), ("frustrated", -2.1), ("frustrating", -2.2), ("glitch", -1.5), ("hard", -0.9), ("horrible", -2.8),
    ("issue", -1.0), ("issues", -1.1), ("lack", -1.3), ("lacking", -1.4), ("lacks", -1.3), ("lag", -1.2), ("limited", -0.9), ("lost", -1.4), ("miss", -1.1), ("missing", -1.2),
    ("negative", -1.9), ("outage", -1.8), ("overpriced", -1.9), ("pain", -2.1), ("painful", -2.2), ("problem", -1.6), ("problems", -1.7), ("regret", -1.9), ("rude", -2.1), ("scam", -2.8),
    ("slow", -1.4), ("steep", -1.0), ("terrible", -2.8), ("threat", -2.2), ("ugly", -2.2), ("unhappy", -2.0), ("unreliable", -2.0), ("unresponsive", -1.7), ("unusable", -2.2),
    ("useless", -2.2), ("waste", -2.0), ("worse", -2.2), ("wrong", -1.8),
]
TOKEN_EDGE_PUNCT = ".,!?;:\"'()[]{}"

# Own lists of words that turn or bend the word after them.
NEGATIONS = ["not", "no", "never", "none", "nobody", "nothing", "nor", "neither", "nowhere", "without", "hardly", "rarely", "seldom", "cannot", "dont", "doesnt", "isnt", "wasnt", "cant", "wont"]
BOOSTERS = ["absolutely", "amazingly", "completely", "deeply", "especially", "exceptionally", "extremely", "greatly", "highly", "hugely", "incredibly", "particularly", "really", "so",
            "totally", "truly", "unusually", "utterly", "very"]
DAMPENERS = ["almost", "barely", "fairly", "kinda", "marginally", "occasionally", "partly", "partially", "scarcely", "slightly", "somewhat", "sorta"]

# Published constants of rule-based polarity (fixed values).
BOOST = 0.293
CAPS = 0.733
NEGATE = -0.74
DISTANCE = (1.0, 0.95, 0.9)
BEFORE_BUT = 0.5
AFTER_BUT = 1.5
EXCLAMATION, EXCLAMATIONS = 0.292, 4
QUESTION, QUESTIONS, MANY_QUESTIONS = 0.18, 3, 0.96
