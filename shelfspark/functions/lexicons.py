"""Word lists and maps whose values the engine's results depend on.  All are fixed values."""

# Words left out of every term list.
STOPWORDS = (
    "a an and are as at be but by for from i in is it its me my of on or please some that the this to want with would you "
    "looking im id ive am was were been have has do does did so just really very can could"
).split()
LOW_VALUE = "product item quality great new amp".split()

# Plurals that no suffix rule reaches: plural, singular.
IRREGULAR = [("men", "man"), ("women", "woman"), ("children", "child"), ("feet", "foot"), ("teeth", "tooth"), ("mice", "mouse"), ("geese", "goose"), ("people", "person")]

# details.Department to audience.
DEPARTMENTS = {
    "womens": "women", "women": "women", "woman": "women", "female": "women", "ladies": "women", "lady": "women", "juniors": "women",
    "mens": "men", "men": "men", "man": "men", "male": "men",
    "unisex adult": "unisex", "unisex-adult": "unisex", "unisexadult": "unisex", "unisex": "unisex", "unisex child": "kids", "unisex-child": "kids",
    "girls": "girls", "girl": "girls", "baby girls": "girls", "baby-girls": "girls", "boys": "boys", "boy": "boys", "baby boys": "boys", "baby-boys": "boys",
    "kids": "kids", "children": "kids", "child": "kids", "toddler": "kids", "baby": "kids", "infant": "kids",
}

# Audience words of titles and category levels.
TITLE_AUDIENCE = {
    "women": "women", "womens": "women", "woman": "women", "ladies": "women", "men": "men", "mens": "men", "man": "men", "girl": "girls", "girls": "girls",
    "boy": "boys", "boys": "boys", "unisex": "unisex", "kids": "kids", "toddler": "kids", "baby": "kids",
}

# Category levels that say nothing.
CATEGORY_NOISE = [
    "clothing", "shoes", "jewelry", "clothing shoes & jewelry", "clothing, shoes & jewelry", "novelty & more", "clothing shoes jewelry", "shoes & jewelry", "shoes and jewelry",
]

# What customers say.
MATERIALS = (
    "cotton polyester nylon leather wool spandex silk rayon fabric denim linen cashmere suede satin velvet mesh acrylic bamboo alloy sterling silver gold steel titanium brass copper rubber canvas"
).split()
COLORS = "black white blue red pink green brown gray grey purple yellow orange beige navy gold silver ivory burgundy teal khaki cream".split()
SIZES = "xs small medium large xl xxl petite plus regular wide narrow slim".split()
USE_CASES = "hiking running gym workout winter summer outdoor work wedding party casual formal travel beach sleep yoga office school everyday date dinner".split()

# Audience words of messages.
SPOKEN_AUDIENCE = {
    "women": "women", "womens": "women", "woman": "women", "ladies": "women", "female": "women", "her": "women", "she": "women", "men": "men", "mens": "men", "man": "men",
    "male": "men", "him": "men", "he": "men", "girls": "girls", "girl": "girls", "boys": "boys", "boy": "boys", "kids": "kids", "children": "kids", "toddler": "kids", "baby": "kids", "unisex": "unisex",
}

# Words before leather or suede that make it something else, and other names of the real thing.
FAKE_QUALIFIERS = ["faux", "synthetic", "pu", "vegan", "artificial", "manmade", "man-made", "imitation", "fake"]
GENUINE = {"leather": ["genuine leather", "cowhide", "sheepskin", "lambskin", "nappa", "calfskin", "full grain", "full-grain", "top grain", "top-grain"]}

# Single words that are never taken for a brand.
NOT_BRANDS = (
    "fashion classic original premium quality style comfort essentials collection apparel clothing brand generic unbranded sports outdoor casual modern simple basic "
    "gold silver star love cool pure true one gap next new the and for art sun sky top hot"
).split()

# Words of customer templates that are no content.
BOILERPLATE = (
    "key requirement requirements matter matters need needs preference preferences additional judgment judgement option options quite right yet ask specific attribute attributes "
    "exploring explore ignore earlier actually still prefer prioritize prioritise target instead rather thing something anything sure maybe"
).split()
SCAFFOLD = [
    r"i'?m looking for", r"i am looking for", r"a key requirement is", r"key requirement is", r"for that,? what matters is", r"actually,? ignore my earlier preference",
    r"actually,? ignore my earlier", r"what i need is", r"what i want is", r"i don'?t have an additional preference for", r"i don'?t have a preference for",
    r"please use your judgment", r"please use your judgement", r"those options are not quite right yet", r"ask me about one specific attribute", r"but i'?m still exploring",
    r"i'?m still exploring", r"please prioriti[sz]e the target requirements", r"i prefer a different style",
]
OVERRIDE_MARKERS = ["actually", "instead", "rather", "no, i want", "changed my mind", "ignore my earlier", "on second thought", "scratch that", "forget"]
BROWSING_MARKERS = ["still exploring", "not sure", "just looking", "browsing", "ideas", "suggestions", "recommend", "something", "anything", "exploring", "open to", "help me find", "what do you"]
BUYING_MARKERS = ["requirement", "must", "need", "specifically", "exactly", "only", "has to", "looking for a", "i want", "buy"]

# Preference tags to words of listings.
TAG_WORDS = {
    "fit": ["fit", "fitted", "true to size", "slim", "relaxed", "tailored", "sizing"],
    "comfort": ["comfort", "comfortable", "soft", "breathable", "lightweight", "cozy"],
    "durability": ["durable", "sturdy", "long lasting", "heavy duty", "reinforced", "quality"],
    "style": ["style", "stylish", "fashion", "trendy", "elegant", "classic", "chic"],
    "material": ["cotton", "leather", "wool", "polyester", "fabric", "material", "silk"],
    "price": ["affordable", "value", "budget", "cheap", "inexpensive"],
    "color": ["color", "colour", "vibrant", "shade"],
    "size": ["size", "sizing", "petite", "plus", "wide", "narrow"],
    "quality": ["quality", "premium", "craftsmanship", "well made"],
    "versatility": ["versatile", "everyday", "all occasions", "multi purpose"],
}

# The simulator's own vocabulary.
CARD_MATERIALS = "cotton polyester nylon leather wool spandex silk rayon fabric".split()
CARD_COLORS = "black white blue red pink green brown gray grey purple yellow orange".split()
CARD_NOISE = ["clothing", "clothing shoes & jewelry", "clothing, shoes & jewelry"]
CONSTRAINT_WORDS = [
    ("material", CARD_MATERIALS),
    ("color", ["color", "black", "white", "blue", "red", "pink", "green"]),
    ("size", ["size", "sizing", "width", "wide", "narrow"]),
    ("style", ["department", "style", "fit", "sleeve", "neck"]),
    ("use_case", ["hiking", "running", "gym", "winter", "outdoor", "work"]),
]

# Fields of the index with their BM25 b and weight; k1 and other retrieval constants.
FIELDS = {"title": (0.45, 1.0), "features": (0.75, 1.25), "categories": (0.3, 0.7), "description": (0.75, 0.8), "store": (0.2, 0.35)}
K1, MAX_DF, FUSION_ALPHA, GRAM_MAX_DF, GRAM = 1.2, 0.35, 0.78, 0.25, 4
# Weights of the linear model by feature, and those an intent replaces.
WEIGHTS = {
    "fused": 1.0, "bm25_title": 0.26, "bm25_features": 0.3, "bm25_categories": 0.11, "bm25_description": 0.0, "bm25_store": 0.0, "dense": 0.18,
    "phrase_title": 0.16, "phrase_features": 0.13, "phrase_categories": 0.5, "span_coverage": 0.0, "span_all": 0.4, "coverage": 0.6, "title_low_coverage": -0.2,
    "popularity_low_coverage": -0.4, "popularity": 0.88, "quality": 0.015, "has_description": 0.01, "n_features_norm": 0.07,
    "gender_satisfied": 0.055, "gender_violated": -0.23, "brand_satisfied": 0.18, "brand_violated": -0.06, "category_satisfied": 0.12, "category_violated": -0.07,
    "material_satisfied": 0.07, "material_violated": -0.02, "color_satisfied": 0.045, "color_violated": -0.015,
    "gender_unknown": -0.01, "brand_unknown": 0.0, "category_unknown": -0.005, "material_unknown": 0.0, "color_unknown": 0.0, "profile_affinity": 0.06, "category_focus": 0.0,
}
INTENT_WEIGHTS = {"buying": {"fused": 0.0, "bm25_title": 0.18}, "uncertain": {"fused": 0.0}, "browsing": {}}

# Sessions: what replaces a value, slots a change of mind may clear, and weights of statements, fields and intents.
REPLACED_CUE = r"\b(?:instead of|rather than|not)\b"
SOFT_SLOTS = ("materials", "colors", "sizes", "use_cases", "brands")
IDENTITY_SLOTS = ("categories", "gender")
DECAY, RECENCY = 0.25, 0.15
BLENDS = {"title": (1.0, 0.85), "features": (0.35, 1.0), "categories": (1.0, 0.25), "description": (0.3, 0.7), "store": (0.1, 0.6)}
INTENT_PARTS = {"density": 0.4, "markers": 0.25, "specificity": 0.25, "alignment": 0.1}
INTENT_BOUNDS = (0.35, 0.65)
# The customer's templates: the kind asked for, what leads in a requirement, a refusal.
CATEGORY_PATTERN = r"looking for\s+(.+?)(?:[.,]|$)"
LEAD_IN_PATTERN = r"(?:requirement is|matters is|need is|want is|preference:)\s*:?\s*(.+)$"
REFUSAL_PATTERN = r"don'?t have (?:an? )?(?:additional )?preference for (\w+)"
