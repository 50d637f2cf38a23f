"""Word rules that read attributes from names, categories and
listing texts, and the tables that score them.

Patterns are Java regular expressions. Name, category and grape patterns see
upper-case text without accents; text patterns ignore case. Earlier rules win.
"""

VERSION = "1"

# Grapes and the words that name them.
GRAPES = [
    ("Cabernet Franc", r"\bCAB(?:ERNET)?\.? FRANC\b"),
    ("Cabernet Sauvignon", r"\bCAB(?:ERNET)?\.? SAUV(?:IGNON)?\b|\bCABERNET\b(?! FRANC)|\bCAB\b(?! FRANC)"),
    ("Sauvignon Blanc", r"\bSAUV(?:IGNON)?\.? BL(?:ANC|C)?\b|\bFUME BLANC\b"),
    ("Chardonnay", r"\bCHARD(?:ONNAY)?\b|\bCHD\b"),
    ("Riesling", r"\bRIESL(?:IN)?G?\b"),
    ("Pinot Grigio", r"\bPINOT GRIGIO\b|\bP(?:NT)?\.? GRIGIO\b"),
    ("Pinot Gris", r"\bPINOT GRIS\b"),
    ("Pinot Blanc", r"\bPINOT BLANC\b|\bPINOT BIANCO\b"),
    ("Pinot Noir", r"\bPINOT NOIR\b|\bPINOT NR\b|\bPN\b(?=.*\bPINOT\b)"),
    ("Moscato", r"\bMOSCATO\b|\bMUSCAT\b|\bMOSCATEL\b"),
    ("Gewürztraminer", r"\bGEWURZ(?:TRAMINER)?\b"),
    ("Albariño", r"\bALBARINO\b|\bALVARINHO\b"),
    ("Chenin Blanc", r"\bCHENIN\b"),
    ("Viognier", r"\bVIOGNIER\b"),
    ("Grüner Veltliner", r"\bGRUNER\b"),
    ("Vermentino", r"\bVERMENTINO\b"),
    ("Verdejo", r"\bVERDEJO\b"),
    ("Torrontés", r"\bTORRONTES\b"),
    ("Sémillon", r"\bSEMILLON\b"),
    ("Picpoul", r"\bPICPOUL\b"),
    ("Assyrtiko", r"\bASSYRTIKO\b"),
    ("Godello", r"\bGODELLO\b"),
    ("Xarel·lo", r"\bXAREL\.?L?O\b"),
    ("Garganega", r"\bGARGANEGA\b"),
    ("Fiano", r"\bFIANO\b"),
    ("Falanghina", r"\bFALANGHINA\b"),
    ("Arneis", r"\bARNEIS\b"),
    ("Cortese", r"\bCORTESE\b"),
    ("Trebbiano", r"\bTREBBIANO\b"),
    ("Marsanne", r"\bMARSANNE\b"),
    ("Roussanne", r"\bROUSSANNE\b"),
    ("Merlot", r"\bMERLOT\b"),
    ("Zinfandel", r"\bZIN(?:FANDEL)?\b"),
    ("Primitivo", r"\bPRIMITIVO\b"),
    ("Petite Sirah", r"\bPETITE SIRAH\b|\bPET(?:ITE)? SIRAH\b"),
    ("Syrah", r"\bSYRAH\b(?<!PETITE SYRAH)|\bSHIRAZ\b"),
    ("Malbec", r"\bMALBEC\b"),
    ("Tempranillo", r"\bTEMPRANILLO\b"),
    ("Grenache Blanc", r"\bGRENACHE BLANC\b|\bGARNACHA BLANCA\b"),
    ("Grenache", r"\bGRENACHE\b(?! BLANC)|\bGARNACHA\b(?! BLANCA)"),
    ("Sangiovese", r"\bSANGIOVESE\b"),
    ("Nebbiolo", r"\bNEBBIOLO\b"),
    ("Barbera", r"\bBARBERA\b"),
    ("Dolcetto", r"\bDOLCETTO\b"),
    ("Montepulciano", r"\bMONTEPULCIANO D'ABRUZZO\b"),
    ("Carménère", r"\bCARMENERE\b"),
    ("Gamay", r"\bGAMAY\b"),
    ("Mourvèdre", r"\bMOURVEDRE\b|\bMONASTRELL\b"),
    ("Pinotage", r"\bPINOTAGE\b"),
    ("Nero d'Avola", r"\bNERO D'?AVOLA\b"),
    ("Aglianico", r"\bAGLIANICO\b"),
    ("Lambrusco", r"\bLAMBRUSCO\b"),
    ("Zweigelt", r"\bZWEIGELT\b"),
]

# Appellations whose grape is fixed, the grape, and the note.
APPELLATIONS = [
    (r"\bCHABLIS\b", "Chardonnay", "Chablis"),
    (r"\bSANCERRE\b|\bPOUILLY[- ]FUME\b", "Sauvignon Blanc", "Sancerre / Pouilly-Fumé"),
    (r"\bVOUVRAY\b", "Chenin Blanc", "Vouvray"),
    (r"\bBAROLO\b|\bBARBARESCO\b", "Nebbiolo", "Barolo / Barbaresco"),
    (r"\bBRUNELLO\b|\bROSSO (?:DI )?MONTALCIN", "Sangiovese", "Montalcino"),
    (r"\bGAVI\b", "Cortese", "Gavi"),
    (r"\bSOAVE\b", "Garganega", "Soave"),
    (r"\bMOSCATO D'ASTI\b|\bASTI SPUMANTE\b", "Moscato", "Asti"),
    (r"\bBEAUJOLAIS\b|\bMORGON\b|\bFLEURIE\b", "Gamay", "Beaujolais"),
    (r"\bMUSCADET\b", "Melon de Bourgogne", "Muscadet"),
    (r"\bCHIANTI\b", "Sangiovese", "Chianti (mainly Sangiovese)"),
    (r"\bRIBERA DEL DUERO\b", "Tempranillo", "Ribera del Duero (mainly Tempranillo)"),
]

# Regions stated by the category, then by the name or text.
CATEGORY_REGIONS = [
    (r"^FRENCH (?:RED|WHITE) - BURGUNDY", "Burgundy, France"),
    (r"^FRENCH (?:RED|WHITE) - BORDEAUX", "Bordeaux, France"),
    (r"^FRENCH WHITE - BORDEAUX & LOIRE", "Bordeaux or Loire, France"),
    (r"^FRENCH RED - RHONE", "Rhône, France"),
    (r"^FRENCH (?:RED|WHITE)", "France"),
    (r"^ITALIAN RED - PIEDMONT", "Piedmont, Italy"),
    (r"^ITALIAN RED - (?:TUSCANY|CHIANTI)", "Tuscany, Italy"),
    (r"^ITALIAN (?:RED|WHITE)", "Italy"),
    (r"^SPANISH RED - RIOJA", "Rioja, Spain"),
    (r"^SPANISH (?:RED|WHITE)", "Spain"),
    (r"^PORTUG[UE]+SE", "Portugal"),
    (r"^GERMAN", "Germany or Austria"),
    (r"^NEW ZEALAND", "New Zealand"),
    (r"^AUSTRALIAN", "Australia"),
    (r"^ARGENTINE", "Argentina"),
    (r"^CHILEAN", "Chile"),
    (r"^SOUTH AFRICAN", "South Africa"),
    (r"^SPARKLING WINE - FRENCH & CHAMPAGNE", "France"),
    (r"^SPARKLING WINE - PROSECCO", "Italy (Prosecco)"),
    (r"^SPARKLING WINE - DOMESTIC|^ROSE WINE - DOMESTIC", "United States"),
]
NAME_REGIONS = [
    (r"\bNAPA\b", "Napa Valley, California"),
    (r"\bSONOMA\b|\bRUSSIAN RIVER\b|\bRR\b(?=.*PINOT)|\bALX VLY\b|\bALEXANDER VALLEY\b", "Sonoma, California"),
    (r"\bPASO ROBLES\b", "Paso Robles, California"),
    (r"\bSANTA LUCIA\b|\bSLH\b", "Santa Lucia Highlands, California"),
    (r"\bLODI\b", "Lodi, California"),
    (r"\bWILLAMETTE\b", "Willamette Valley, Oregon"),
    (r"\bCOLUMBIA VALLEY\b|\bCOL VLY\b", "Columbia Valley, Washington"),
    (r"\bMARLBOROUGH\b", "Marlborough, New Zealand"),
    (r"\bCHABLIS\b", "Chablis, France"),
    (r"\bSANCERRE\b", "Sancerre, France"),
    (r"\bVOUVRAY\b", "Vouvray, France"),
    (r"\bPROVENCE\b|\bCOTES DE PROVENCE\b", "Provence, France"),
    (r"\bALSACE\b", "Alsace, France"),
    (r"\bMOSEL\b", "Mosel, Germany"),
    (r"\bRIAS BAIXAS\b", "Rías Baixas, Spain"),
    (r"\bVINHO VERDE?\b|\bVINHO VERD\b", "Vinho Verde, Portugal"),
    (r"\bTXAKOLI(?:NA)?\b|\bGETARIAKO\b", "Basque Country, Spain (Txakoli)"),
    (r"\bSOAVE\b", "Soave, Italy"),
    (r"\bORVIETO\b", "Orvieto, Italy"),
    (r"\bGAVI\b", "Gavi, Italy"),
    (r"\bASTI\b", "Asti, Italy"),
    (r"\bBAROLO\b", "Barolo, Italy"),
    (r"\bCHIANTI\b", "Chianti, Italy"),
    (r"\bMONTALCIN", "Montalcino, Italy"),
    (r"\bRIOJA\b", "Rioja, Spain"),
    (r"\bCHATEAUNEUF\b", "Châteauneuf-du-Pape, France"),
    (r"\bUTAH\b", "Utah"),
]

# Label words that state sweetness.
LABEL_SWEETNESS = [
    (r"\bBRUT NATURE\b|\bEXTRA BRUT\b|\bZERO DOSAGE\b", "dry"),
    (r"\bEXTRA DRY\b|\bEXTRA SEC\b", "off-dry"),
    (r"\bDEMI[- ]?SEC\b|\bDOUX\b|\bDOLCE\b|\bAMABILE\b|\bDULCE\b", "sweet"),
    (r"\bLATE HARVEST\b|\bLATE HRVST\b|\bICE ?WINE\b|\bEISWEIN\b|\bSAUTERNES\b", "sweet"),
    (r"\bSEMI[- ]?SWEET\b|\bSEMI[- ]?SWT\b", "medium-sweet"),
    (r"\bSWEET\b|\bSWT\b", "sweet"),
    (r"\bBRUT\b", "dry"),
    (r"\bTROCKEN\b|\bDRY RIESLING\b|\bDRY ROSE\b|\bDRY\b(?! CREEK)", "dry"),
]

# Aromas that use the word "sweet" without meaning the taste.
NOT_SWEET = (
    r"^sweet (?:spice|spices|oak|tannins?|vanilla|cherr|berr|fruit|notes|aromas|tobacco|herbs?|nuance|bay|pipe|earth|smoke|toast|"
    r"lemon|licorice|plum|cassis|red fruit|black fruit|dark fruit|pepper)"
)

# Listing texts: (value, pattern, confidence).
TEXT_SWEETNESS = [
    (
        "dry",
        r"\bnot (?:overly |too )?sweet\b|\bbone[- ]dry\b|\bdry (?:white|red|wine|style|finish|and crisp|riesling|chenin|muscat|moscato|"
        r"gew[uü]rztraminer|furmint|vouvray)\b|\bdry ros[eé](?![a-z])|\bcrisp(?:,| and) dry\b|\bdry,? crisp\b",
        "high",
    ),
    ("off-dry", r"\boff[- ]dry\b|\b(?:hint|touch) of sweetness\b|\b(?:slightly|lightly|gently|just) sweet\b|\bnot too dry\b", "high"),
    ("medium-sweet", r"\bsemi[- ]sweet\b|\bmedium[- ]sweet\b|\bsweet(?:er)? style\b", "high"),
    (
        "sweet",
        r"^sweet\b|\bsweet (?:wine|moscato|red|white|sparkling|blush|dessert)\b|\bsweet ros[eé](?![a-z])|"
        r"\b(?:fruity|soft|juicy|light) and sweet\b|\bdessert wine\b|\blusciously sweet\b|\bnaturally sweet\b|"
        r"\bsweet and (?:fruity|refreshing|light)\b",
        "high",
    ),
]
TEXT_BODY = [
    ("light", r"\blight[- ]bodied\b|\blight(?:er)? body\b|\blight and (?:crisp|refreshing|fresh)\b|\blightweight\b", "high"),
    ("medium", r"\bmedium[- ]bodied\b|\bmedium(?:[- ]plus)? body\b", "high"),
    ("full", r"\bfull[- ]bodied\b|\bfull body\b", "high"),
    ("full", r"\b(?:big|bold|robust|powerful)\b", "medium"),
    ("light", r"\bdelicate\b", "medium"),
]
TEXT_TAGS = [
    ("crisp", r"\bcrisp\b|\bzesty\b|\bzippy\b|\bracy\b|\b(?:bright|vibrant|lively|fresh|refreshing|mouthwatering) acidity\b", "high"),
    ("refreshing", r"\brefreshing\b|\brefreshment\b", "high"),
    ("fruity", r"\bfruit[- ]forward\b|\bfruity\b|\bjuicy\b", "high"),
    ("oaky", r"\boak(?:y|ed)?\b|\bvanilla\b|\btoasted oak\b|\bbuttery\b", "high"),
    ("creamy", r"\bcreamy\b|\bbuttery\b|\brich,? round\b", "high"),
    ("floral", r"\bfloral\b|\bflowers?\b|\bblossoms?\b|\bhoneysuckle\b", "high"),
    ("mineral", r"\bminerals?\b|\bminerality\b|\bflinty\b|\bsaline\b|\bstony\b|\bchalky\b", "high"),
    ("earthy", r"\bearth(?:y|iness)?\b", "high"),
    ("spicy", r"\bspic(?:e|es|y)\b|\bpepper(?:y)?\b", "high"),
    ("smooth", r"\bsmooth\b|\bsilky\b|\bvelvety\b|\bsoft tannins\b", "high"),
]
TEXT_FIZZ = [
    (
        "lightly sparkling",
        r"\beffervescen(?:t|ce)\b|\bfrizzante\b|\bp[eé]tillant\b|\blightly sparkling\b|\bspritz(?:y)?\b|\b(?:slight|light) fizz\b",
        "high",
    ),
]

# General style knowledge, used only where the product says
# nothing: (key, condition, sweetness, body, tag, confidence, note). Conditions
# are SQL over one_grape, has_moscato, color, fizz, region and name flags.
STYLE_RULES = [
    ("moscato-asti", "n_asti", "sweet", "light", None, "medium", "Moscato d'Asti is typically sweet, light and lightly sparkling"),
    ("moscato", "has_moscato", "sweet", None, None, "medium", "Moscato is typically made sweet"),
    ("white-zin", "n_white_zin", "off-dry", None, None, "medium", "White Zinfandel is typically off-dry to sweet"),
    ("gewurz", "one_grape = 'Gewürztraminer'", "off-dry", None, "floral", "low", "Gewürztraminer is often off-dry and floral"),
    ("pinot-grigio", "one_grape in ('Pinot Grigio', 'Pinot Gris')", "dry", "light", None, "medium", "Pinot Grigio is typically dry and light-bodied"),
    ("sauv-blanc", "one_grape = 'Sauvignon Blanc'", "dry", None, "crisp", "medium", "Sauvignon Blanc is typically dry and crisp"),
    ("albarino", "one_grape = 'Albariño'", "dry", "light", "crisp", "medium", "Albariño is typically dry, light and crisp"),
    ("txakoli", "region like '%Txakoli%'", "dry", "light", "crisp", "medium", "Txakoli is typically dry, light and crisp, often with a slight spritz"),
    ("gruner", "one_grape = 'Grüner Veltliner'", "dry", None, "crisp", "medium", "Grüner Veltliner is typically dry and crisp"),
    ("chardonnay", "one_grape = 'Chardonnay'", "dry", None, None, "medium", "Chardonnay is typically dry"),
    ("provence-rose", "color = 'rose' and region like '%Provence%'", "dry", "light", None, "medium", "Provence rosé is typically dry and light"),
    ("brut-sparkling", "fizz = 'sparkling' and n_champagne", "dry", None, None, "low", "Champagne, Cava and Crémant are most often made Brut (dry)"),
    ("pinot-noir", "color = 'red' and one_grape = 'Pinot Noir'", "dry", "light", None, "medium", "Pinot Noir is typically dry and lighter-bodied for a red"),
    ("gamay", "one_grape = 'Gamay'", "dry", "light", "fruity", "medium", "Gamay (Beaujolais) is typically dry, light and fruity"),
    (
        "big-reds",
        "color = 'red' and one_grape in ('Cabernet Sauvignon', 'Syrah', 'Petite Sirah', 'Malbec', 'Zinfandel', 'Primitivo')",
        "dry", "full", None, "medium", "this grape typically makes dry, full-bodied reds",
    ),
    ("merlot", "color = 'red' and one_grape = 'Merlot'", "dry", "medium", None, "medium", "Merlot is typically dry and medium-bodied"),
]
NAME_FLAGS = {
    "n_asti": r"\bMOSCATO D'ASTI\b|\bASTI\b",
    "n_white_zin": r"\bWH(?:ITE)? ZIN",
    "n_champagne": r"\bCHAMPAGNE\b|\bCAVA\b|\bCREMANT\b",
}

# Points of a value for a wish, and the weight of its evidence.
SWEET_POINTS = {
    "dry": {"dry": 3.0, "off-dry": 1.0, "medium-sweet": -3.0, "sweet": -4.0},
    "offdry": {"dry": -3.0, "off-dry": 3.0, "medium-sweet": 2.5, "sweet": 1.5},
    "sweet": {"dry": -4.0, "off-dry": 0.0, "medium-sweet": 2.0, "sweet": 3.0},
}
BODY_POINTS = {
    "light": {"light": 2.0, "medium": 0.0, "full": -2.0},
    "medium": {"light": 0.0, "medium": 2.0, "full": 0.0},
    "full": {"light": -2.0, "medium": 0.0, "full": 2.0},
}
WEIGHTS = {
    "manual high": 1.0,
    "product high": 1.0, "product medium": 0.8, "product low": 0.5,
    "style medium": 0.6, "style low": 0.4,
}

# Rating and award lines, never quoted.
RATINGS = (
    r"(?i)\b\d{2,3}\s*(?:points?|pts?)\b\s*(?:[-–,:]\s*)?(?:by\s+)?(?:Decanter|Wine Spectator|Wine Enthusiast|Wine Advocate|"
    r"James Suckling|Jeb Dunnuck|Vinous|Robert Parker|Wine & Spirits|Tasting Panel|Wine Star)?"
)
RATING_CODES = r"\b\d{2,3}\s*(?:GP|WS|WE|WA|RP|JS|JD|V|W&S|WW|D|DWWA)\b"

# Words of typed requests: grapes with the type they imply.
ASK_GRAPES = [
    (r"\bsauvignon blanc\b|\bsauv blanc\b", "Sauvignon Blanc", "white"),
    (r"\bchardonnay\b|\bchard\b", "Chardonnay", "white"),
    (r"\briesling\b", "Riesling", "white"),
    (r"\bpinot gri(?:gio|s)\b", "Pinot Grigio", "white"),
    (r"\bmoscato\b|\bmuscat\b", "Moscato", None),
    (r"\bgew[uü]rztraminer\b", "Gewürztraminer", "white"),
    (r"\balbari[nñ]o\b", "Albariño", "white"),
    (r"\bchenin blanc\b", "Chenin Blanc", "white"),
    (r"\bviognier\b", "Viognier", "white"),
    (r"\bgr[uü]ner(?: veltliner)?\b", "Grüner Veltliner", "white"),
    (r"\bpinot noir\b", "Pinot Noir", "red"),
    (r"\bcabernet sauvignon\b|\bcabernet\b|\bcab\b", "Cabernet Sauvignon", "red"),
    (r"\bmerlot\b", "Merlot", "red"),
    (r"\bzinfandel\b|\bzin\b", "Zinfandel", "red"),
    (r"\bsyrah\b|\bshiraz\b", "Syrah", "red"),
    (r"\bmalbec\b", "Malbec", "red"),
    (r"\btempranillo\b", "Tempranillo", "red"),
    (r"\bsangiovese\b", "Sangiovese", "red"),
    (r"\bgrenache\b|\bgarnacha\b", "Grenache", "red"),
]
ASK_TYPES = [
    (r"\bsparkling\b|\bbubbly\b|\bbubbles\b|\bchampagne\b|\bprosecco\b|\bcava\b|\bfizzy\b", "sparkling"),
    (r"\bros[eé](?![a-z])|\bblush\b|\bpink wine\b|\bwhite zin(?:fandel)?\b", "rose"),
    (r"\bwhites?\b", "white"),
    (r"\breds?\b", "red"),
]
ASK_SWEET = [
    (r"\bnot (?:too |very |overly |that |super )?sweet\b|\bnot sugary\b", "dry"),
    (
        r"\bnot (?:too |very |overly |that |super )?dry\b|\b(?:a )?(?:little|bit|touch|hint|tad) (?:of )?sweet(?:er|ness)?\b|"
        r"\bslightly sweet\b|\boff[- ]dry\b|\bsemi[- ]dry\b|\bsweet-ish\b|\bsweetish\b",
        "offdry",
    ),
    (r"\bsweet(?:er)?\b|\bdessert\b", "sweet"),
    (r"\bbone[- ]dry\b|\bdry\b", "dry"),
]
ASK_BODY = [
    (r"\blight(?:er)?[- ]bodied\b|\blight(?:er)?\b|\beasy[- ]drinking\b", "light"),
    (r"\bmedium[- ]bodied\b|\bmedium body\b", "medium"),
    (r"\bfull(?:er)?[- ]bodied\b|\bbold\b|\bbig\b|\bheavy\b|\brich\b", "full"),
]
ASK_TAGS = [
    (r"\bcrisp\b|\bzesty\b|\btart\b|\bacidic\b|\bbright\b", "crisp"),
    (r"\brefreshing\b", "refreshing"),
    (r"\bfruity\b|\bfruit[- ]forward\b|\bjuicy\b", "fruity"),
    (r"\boaky\b|\boaked\b", "oaky"),
    (r"\bbuttery\b|\bcreamy\b", "creamy"),
    (r"\bfloral\b|\baromatic\b", "floral"),
    (r"\bmineral(?:ly|ity)?\b", "mineral"),
    (r"\bearthy\b", "earthy"),
    (r"\bspicy\b|\bpeppery\b", "spicy"),
    (r"\bsmooth\b|\bsilky\b|\bvelvety\b", "smooth"),
]
ASK_SUMMER = r"\bsummer\b|\bpatio\b|\bpool(?:side)?\b|\bpicnic\b|\bporch\b|\bhot day\b|\bbeach\b"
ASK_NOVELTY = [
    (r"\b(?:unusual|less common|uncommon|different|interesting|obscure) (?:grape|variet(?:y|al)|style)\b", "style"),
    (r"\bhard(?:er)? to find\b|\brare\b|\bscarce\b|\bhard to get\b", "scarce"),
    (
        r"\bnot (?:super |too |very |that |so )?common\b|\buncommon\b|\bunusual\b|\bdifferent\b|\boff the beaten path\b|"
        r"\bsomething new\b|\bobscure\b|\blesser[- ]known\b|\bunique\b|\binteresting\b",
        "ask",
    ),
]
ASK_STOP = [
    "a", "an", "the", "that", "is", "isn't", "which", "and", "or", "but", "with", "for", "to", "of", "in", "on",
    "i", "i'd", "id", "i'm", "me", "my", "we", "want", "wants", "like", "love", "looking", "find", "need", "something",
    "some", "any", "one", "bottle", "bottles", "wine", "wines", "please", "good", "nice", "great", "not", "too",
    "super", "very", "really", "kind", "sort", "maybe", "would", "enjoy", "can", "get", "it", "its", "it's", "be",
    "under", "below", "less", "than", "around", "about", "near", "by", "at", "cheap", "budget", "price", "priced",
    "dollars", "bucks", "up", "max", "most", "no", "more", "just", "also", "style", "taste", "tastes", "drink",
    "glass", "bit", "little", "touch", "hint", "slightly", "somewhat", "what", "show", "recommend", "suggest",
]
