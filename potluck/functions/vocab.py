"""Vocabularies and patterns of the recipe domain.

Word lists are kept sorted, one blank-separated string per list; "_" stands for a blank inside
an entry. Order matters only where a list says so. Patterns avoid look-behind and are written so that
Java (with (?iU)) and Python (with re.IGNORECASE) accept the same strings.
"""

from __future__ import annotations


def _list(text: str) -> list[str]:
    return [w.replace("_", " ") for w in text.split()]


def opt(pattern: str) -> str:
    return f"(?:{pattern})?"


def either(*patterns: str) -> str:
    return "(?:" + "|".join(patterns) + ")"


_NUMBER = r"\d+"
_SPACES, _GAP = r"\s+", r"\s*"

FRACTIONS = "¼½¾⅓⅔⅕⅖⅗⅘⅙⅚⅐⅛⅜⅝⅞"
SCORE_FRACTIONS = "¼½¾⅓⅔⅛⅜⅝⅞"

_UNITS = _list(
    "bag box bunch can clove container cup gallon gram head jar kg lb liter litre milliliter ml ounce oz package pint pound "
    "quart slice sprig stalk stick tablespoon tbsp teaspoon tsp"
)
_SIZES = _list("dried fresh frozen good-sized large medium small whole")
_FOODS = _list(
    "apple banana basil carrot chicken clove egg garlic leaf leaves lemon lime mint onion orange parsley pear pepper potato squash tomato zucchini"
)


def _longest_first(words: list[str]) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


#: A quantity with a unit, or a count of a common food.
MEASUREMENT = (
    either(r"\b" + _NUMBER + opt("[.,]" + _NUMBER), f"[{FRACTIONS}]")
    + rf"[\s/-]?(?:{_longest_first(_UNITS)})s?\b|\b"
    + _NUMBER
    + opt(_SPACES + "-" + _SPACES + _NUMBER)
    + _SPACES
    + opt(_longest_first(_SIZES))
    + rf"{_GAP}(?:{_longest_first(_FOODS)})s?\b"
)

#: Words that count as cooking verbs; always whole words.
COOKING_VERBS = _list(
    "add adjust arrange bake beat boil bring brush caramelize chill chop combine continue cook cool cover crush dilute dissolve "
    "divide drain drizzle dunk fold freeze fry garnish grill harden heat knead lay let melt mix place pour preheat prepare "
    "reduce refrigerate remove repeat roast roll sauté seal season serve simmer slice slowly smoke spray spread sprinkle steep "
    "stir store strain swirl take toast toss transfer watch whisk"
)

_COLON = r"[:\s]+"
SERVES = either("serves?", "servings?", "yields?", "makes?") + _COLON + "(" + _NUMBER + opt(_GAP + either("-", "to") + _GAP + _NUMBER) + ")"


def _time(kinds: str, until: str) -> str:
    return kinds + opt(_GAP + "time") + _COLON + r"([^.\n]+?)" + rf"(?=\n|{until}|$)"


PREP_TIME = _time(either("active", "total", "prep" + opt("aration")), "cook")
COOK_TIME = _time(either("baking", "passive", "cook" + opt("ing")), "prep")

INGREDIENT_KEYWORDS = ["what you need", "you'll need", "ingredient"]
INSTRUCTION_KEYWORDS = _list(
    "cooking_instructions direction how_to instruction let's_cook method preparation recipe_method steps the_method to_cook to_make to_prepare to_serve"
)
EXTRA_INSTRUCTION_KEYWORDS = ["how to prepare"]
NARRATIVE_PREFIX = r"^(?:for the|to (?:assemble|cook|make|prepare|serve))\s+(?:the\s+)?\w+[:\s]"

EXCLUDED = _list(
    "about_the_author acknowledgment basics chapter contents conversion_chart copyright cover dedication equipment_list foreword "
    "fundamentals glossary history how_to_cut how_to_make index introduction mechanics preface techniques tips tools_needed"
)

#: Order decides: the first method whose word occurs is the method.
METHODS = [(m, [m, past]) for m, past in (p.split("/") for p in "smoke/smoked grill/grilled roast/roasted bake/baked fry/fried".split())]
#: Order decides here too.
PROTEINS = "beef pork chicken lamb fish seafood turkey duck".split()

#: Titles that name a part of a recipe, each anchored at the start.
_NEEDED, _END = opt(_SPACES + "needed"), ":?$"
SUB_SECTIONS = [
    opt("special" + _SPACES) + "equipment" + _NEEDED + _END,
    either("gear", "tools?") + _NEEDED + ":?.*$",
    _SPACES.join(["what", "you" + opt("'ll"), "need"]) + _END,
    either(*"active chilling cook cooling grilling infusing marinating passive prep resting rising smoking total".split()) + _SPACES + "time:?.*$",
    either("makes?", "serves?", "servings?", "yields?") + ":?" + _GAP + r"\d*$",
    either("for" + _SPACES + "serving", "to" + _SPACES + "serve", "garnish", "presentation") + _END,
    "for" + _SPACES + "the" + _SPACES,
    either("coarse", "kosher", "sea") + _SPACES + "salt$",
    either("black", "white") + _SPACES + "pepper$",
    either("canola", "olive", "vegetable") + _SPACES + "oil$",
    either("brine", "dressing", "glaze", "marinade", "rub", "sauce") + "$",
    opt("the" + _SPACES) + either("coating", "crust", "filling", "topping") + "$",
    either("note", "tip", "variation") + "s?" + _END,
    either("indoor", "outdoor") + _SPACES + "alternative:?.*$",
    either("chef", "cook") + opt("'s") + _SPACES + either("note", "tip") + "s?" + _END,
]
SUB_SECTION = "^(?:" + "|".join(SUB_SECTIONS) + ")"

_TITLE_UNITS = _list("beans? bottles? cans? cups? g jars? kg l lbs? ml ounces? ozs? packages? pounds? tablespoons? tbsps? teaspoons? tsps?")
QUANTITY_TITLE = "^" + either(_NUMBER + opt(f"{_GAP}[/{SCORE_FRACTIONS}]"), f"[{SCORE_FRACTIONS}]") + rf"{_GAP}(?:{_longest_first(_TITLE_UNITS)})\b"
SINGLE_INGREDIENTS = _list(
    "bay_leaves black_pepper butter coarse_salt egg eggs flour garlic kosher_salt oil olive_oil onion pepper salt sea_salt sugar "
    "vegetable_oil water white_pepper"
)

SCORE_VERBS = _list("add bake boil combine cook fry grill heat mix place remove roast season simmer stir transfer")
SCORE_MEASUREMENT = (
    r"\d+\s*(?:tablespoon|teaspoon|liter|cup|gram|tbsp|tsp|kg|lb|ml|oz)s?|\d+\s*(?:bunch|clove|slice|sprig|stalk|head|can|jar)s?"
    rf"|[{SCORE_FRACTIONS}]"
)

TOC_FOODS = _list(
    "baked beef bread burger cake chicken cookie fish fried grilled lamb pie pizza pork ribs roasted salad salmon sandwich sauce "
    "shrimp smoked soup steak taco"
)
STRUCTURE_INDICATORS = _list("cook_time directions ingredients instructions prep_time serves yield")

TEXT_INGREDIENT_KEYWORDS = ["ingredient", "for the", "shopping list", "what you need", "you will need", "you'll need"]
LINE_VERBS = _list(
    "add arrange bake beat boil bring chop combine cook cover dice drizzle fold fry garnish grill heat mince mix place pour "
    "preheat prepare remove roast saute sear season serve simmer slice spread sprinkle stir transfer whisk"
)
PARAGRAPH_CLASSES = _list("ing ing-item ingd ingredient ings ingst ingt recipe-ingredient")
ZONE_PARAGRAPH_CLASSES = _list("ing ingd ingredient ings ingst ingt")
ZONE_MARKERS = _list("active_time cook_time makes prep_time serves soaking_time yield")
LONG_STARTERS = _list("add bring combine cook heat mix place preheat whisk")
def _phrase(*parts: str) -> str:
    """Parts between word edges, parted by white space."""
    return r"\b" + _SPACES.join(parts) + r"\b"


_BLACK = opt("black" + _SPACES) + "pepper"
LOOSE_INGREDIENT = "|".join(
    [
        _phrase(_NUMBER, opt("large|medium|small|whole") + _GAP + either(*_list("apple carrot egg garlic lemon lime onion orange pear potato tomato")) + "s?"),
        _phrase(_NUMBER, opt("dried|fresh|frozen") + _GAP + r"\w+", either("bunch", "head", "leave", "sprig", "stalk") + "s?"),
        _phrase("salt", "and", _BLACK),
        _phrase(either("coarse", "kosher", "sea"), "salt"),
        _phrase(either("canola", "coconut", "olive", "vegetable"), "oil"),
        _phrase(either("dried", "fresh", "ground"), _BLACK),
        _phrase("to", "taste"),
    ]
)
LOOSE_FOODS = _list(
    "basil beef bread butter carrot cheese chicken cilantro cream egg fish flour garlic lamb lemon lime milk mint noodle oil "
    "onion oregano parsley pasta pepper pork potato rice rosemary salt shrimp sugar thyme tomato turkey water yogurt"
)

INSTRUCTION_CLASSES = _list("dir direction instruction method methodp noindent noindentp noindentt preparation proc procedure step stepp")
STOP_LINE = r"^(?:tips?:|notes?:|serving suggestions?:|variations?:|chef'?s? note:|what else|storage:|make ahead:)"
NOT_INSTRUCTION_CLASSES = ["ihead", "ingredient", "item", "serv", "time", "yield"]

UNITS = _list(
    "bunch bunches box boxes c can cans clove cloves cup cups dash drop drops fl_oz fluid_ounce fluid_ounces g gal gallon gallons "
    "gram grams head heads hint jar jars kg kilogram kilograms l lb lbs leaf leaves liter liters milliliter milliliters ml ounce "
    "ounces oz package packages piece pieces pinch pint pints pkg pound pounds pt qt quart quarts slice slices smidgen sprig "
    "sprigs stalk stalks stick sticks strip strips t tablespoon tablespoons tbs tbsp teaspoon teaspoons ts tsp"
)
_AMOUNT = r"\b" + _NUMBER + r"[\s/\d]*" + _GAP
UNIT_LINE = _AMOUNT + rf"(?:{_longest_first(UNITS)})\b"
FRACTION = f"[{SCORE_FRACTIONS}]|" + opt(_NUMBER + "/") + "/".join([_NUMBER] * 2)
DESCRIPTORS = _list(
    "canned chopped coarsely_chopped cold crisp crushed cubed diced dried extra-large extra-virgin finely_chopped firm fresh "
    "fresh-squeezed frozen grated ground halved hot iodized julienned jumbo kosher large medium minced organic peeled quartered "
    "ripe room_temperature roughly_chopped salted sea shredded sliced small soft sweetened tender thinly_sliced unripe unsalted "
    "unsweetened warm whole xl"
)
NOUNS = _list(
    "apple bacon baking_powder baking_soda banana basil beef beer bell_pepper berries blueberry bread breadcrumbs breast brisket "
    "broccoli broth butter buttermilk carrot cauliflower celery cheddar cheese chicken chili chocolate cilantro cinnamon cloves "
    "cocoa corn cornstarch couscous cream cucumber cumin dill egg eggplant eggs fish flour garlic ginger half-and-half ham honey "
    "jalapeño kale ketchup lamb lemon lettuce lime mango mayonnaise milk mint molasses mozzarella mushroom mustard noodles nutmeg "
    "oats oil onion orange oregano paprika parmesan parsley pasta peas pepper pineapple pork potato quinoa raspberry ribs rice "
    "rosemary salmon salt sausage shrimp sour_cream soy_sauce spinach steak stock strawberry sugar tenderloin thighs thyme tomato "
    "tuna turkey turmeric vanilla vanilla_extract vinegar water wine wings worcestershire yeast yogurt zucchini"
)
_BULLETS = "•\\-*·○●"
LIST_MARKER = "^" + either(rf"[\s{_BULLETS}▪▫■□➤➢→⇒]{_GAP}", _NUMBER + r"\." + _GAP)
INGREDIENT_VERBS = _list("bake beat bring combine cook fold fry grill heat mix pour preheat remove roast serve stir transfer whisk")

TEMPORAL = _list("after as_soon_as before during gradually immediately once slowly then until when while")
SEQUENTIAL = _list("at_the_same_time finally first lastly meanwhile next second simultaneously then third")
IMPERATIVES = _list(
    "add bake beat boil bring chop combine cook cover drain fold fry grill heat melt mix place pour preheat remove roast sauté "
    "season simmer slice spread stir toss transfer whisk"
)

SERVING_WORDS = _list("makes people portions servings serves yield yields")
TIME_WORDS = _list("bake baking cook cooking hours minutes prep preparation ready_in time total")
#: Order decides: the first word found gives the level.
DIFFICULTY = [(w, level) for level, ws in (("easy", "easy simple beginner quick"), ("intermediate", "intermediate moderate"), ("advanced", "advanced difficult expert challenging")) for w in ws.split()]
TIME_UNIT = r"\b(?:hour|hr|minute|min)s?\b"
# "[-to]" is one character: a dash, a "t" or an "o"; "4 to 6" is no range here
SERVING_NUMBER = either("makes", "serves?", "yields?") + _GAP + opt("about" + _GAP) + "(" + _NUMBER + opt(f"{_GAP}[-to]{_GAP}" + _NUMBER) + ")"
METHOD_UNITS = _list("cup ounce tablespoon teaspoon")
PROTEIN_CONTEXT = _list("breast fillet ground steak thigh whole with")
DIFFICULTY_CONTEXT = _list("beginner experience level rating skill")

_LING_BASE = "add bake beat blend boil brown chop combine cook cover dice drain fold fry garnish heat mince mix pour preheat reduce remove rinse sauté season serve simmer slice stir taste whisk"
LEGACY_LINE_VERBS = _list(_LING_BASE)
LING_VERBS = _list(_LING_BASE + " broil grill place roast spread transfer")
LEGACY_DESCRIPTORS = _list(
    "canned chopped coarsely cooked crushed diced dried finely fresh frozen grated ground large medium minced raw sliced small thinly whole"
)
LING_TEMPORAL = _list("after before during finally first meanwhile next once then until when while")
LING_STOPS = _list("chef's_note make_ahead note notes serving_suggestion storage tip tips variation variations")
META_WORDS = _list(
    "bake baking cook cooking difficulty easy hard hours level makes medium minutes portions prep preparation ready serves servings skill time total yield yields"
)
NARRATIVE = _list("after before can may should that the then this until when while will you your")
LING_DESCRIPTORS = _list(
    "canned chopped crisp crushed diced dried extra-large extra-virgin firm fresh fresh-squeezed frozen grated ground halved jumbo "
    "kosher large medium minced organic peeled quartered ripe salted sea shredded sliced small soft sweetened tender unripe "
    "unsalted unsweetened whole"
)
LING_NOUNS = _list("beef butter carrot cheese chicken cream egg eggs fish flour garlic lemon lime milk oil onion pepper pork potato salt sugar tomato water")
LING_UNITS = _list("clove cup cups dash g gram kg kilogram lb ounce oz piece pinch pound tablespoon tbsp teaspoon tsp")
LING_MARKER = "^" + either(rf"[\s{_BULLETS}]{_GAP}", _NUMBER + r"\." + _GAP)
LEGACY_UNITS = _list(
    "clove cloves cup cups dash g gram grams kg kilogram kilograms l lb lbs liter liters milliliter milliliters ml ounce ounces oz "
    "piece pieces pinch pound pounds tablespoon tablespoons tbsp teaspoon teaspoons tsp"
)
LEGACY_KEYWORDS = _list(
    "beef bread broth butter cheese chicken cream egg eggs fish flour garlic lemon lime milk oil onion pasta pepper pork rice salt sauce stock sugar tomato water wine"
)

ZONE_CLASSES = _list(
    "component components groceries grocery ing ingred ingredient ingredients ings item items recipe-ingredient "
    "recipe-ingredients recipeingredient shopping-list shoppinglist"
)
ZONE_IDS = _list("grocery ingred ingredient ingredients ings recipe-ingredient shopping")
ZONE_HEADER = (
    r"\bingredients?\b|\bwhat you(?:'ll)? need\b|\byou(?:'ll| will) need\b|\b(?:grocery|shopping) list\b"
    r"|\bfor (?:the|this) (?:dish|recipe)\b|\bfor the \w+\b"
)
ZONE_ITEM_UNIT = _AMOUNT + r"(?:tbsp|cup|tsp|kg|lb|ml|oz|g|l)s?\b"
META_CLASSES = _list("cook details difficulty info meta metadata prep recipe-details recipe-info recipe-meta recipe-stats servings stats time yield")
META_HEADERS = r"recipe\s+info|details|stats|at\s+a\s+glance"
#: Order is fixed here, where the itemprop set of microdata has none.
ITEMPROPS = [("recipeYield", "servings"), ("totalTime", "total_time"), ("prepTime", "prep_time"), ("cookTime", "cook_time")]
POSITION_WORDS = _list("cook makes prep serves time yield")
LEGACY_ZONE_PATTERNS = "ingredient ingredients ingred recipe-ingredient recipe-ingredients component components item items list listing".split()
LEGACY_HEADER_WORDS = ["for the", "for this recipe", "ingred", "ingredient", "shopping list", "what you need", "you will need"]

_TITLE_SKIPS = "black_pepper chopped coarse_salt cup diced freshly_ground indoor_alternative minced olive_oil ounce outdoor_alternative pound sliced tablespoon teaspoon trimmed"
BOLD_SKIPS = _list(_TITLE_SKIPS + " for_the ingredients makes method serves")
LINE_SKIPS = _list(_TITLE_SKIPS + " bay_leaves bell_pepper")

FILTER_COLUMNS = _list("author book chapter cook@time cooking@method difficulty epub@section prep@time protein@type quality@score serves title")
FILTER_COLUMNS = [c.replace("@", "_") for c in FILTER_COLUMNS]
