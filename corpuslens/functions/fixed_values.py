"""Word lists, patterns and code tables that results depend on. Nothing here is computed."""

# Distorted phrases and what they stand for.
PHRASES = {
    "profound learning": "deep learning",
    "profound brain network": "deep neural network",
    "fake brain network": "artificial neural network",
    "counterfeit brain network": "artificial neural network",
    "counterfeit neural network": "artificial neural network",
    "counterfeit intelligence": "artificial intelligence",
    "fake intelligence": "artificial intelligence",
    "sham intelligence": "artificial intelligence",
    "arbitrary forest": "random forest",
    "arbitrary woodland": "random forest",
    "irregular woodland": "random forest",
    "stochastic forest": "random forest",
    "backing point machine": "support vector machine",
    "backing vector machine": "support vector machine",
    "support vector apparatus": "support vector machine",
    "recurrent brain network": "recurrent neural network",
    "long haul memory": "long short-term memory",
    "long momentary memory": "long short-term memory",
    "convolutional brain network": "convolutional neural network",
    "convolution brain network": "convolutional neural network",
    "generative ill-disposed network": "generative adversarial network",
    "generative antagonistic network": "generative adversarial network",
    "element extraction": "feature extraction",
    "highlight extraction": "feature extraction",
    "characteristic extraction": "feature extraction",
    "include extraction": "feature extraction",
    "choice tree": "decision tree",
    "choice woodland": "decision tree",
    "calculated inclination descent": "gradient descent",
    "angle descent": "gradient descent",
    "back proliferation": "backpropagation",
    "back engendering": "backpropagation",
    "precision and review": "precision and recall",
    "exactness and review": "precision and recall",
    "exchange learning": "transfer learning",
    "move learning": "transfer learning",
    "semi-supervised gaining knowledge": "semi-supervised learning",
    "unaided learning": "unsupervised learning",
    "managed learning": "supervised learning",
    "managed gaining knowledge": "supervised learning",
    "bosom malignant growth": "breast cancer",
    "chest malignant growth": "breast cancer",
    "bosom disease": "breast cancer",
    "prostate malignant growth": "prostate cancer",
    "lung malignant growth": "lung cancer",
    "colorectal malignant growth": "colorectal cancer",
    "cerebrum tumor": "brain tumor",
    "cerebrum tumour": "brain tumour",
    "sham treatment": "placebo",
    "sham examination": "placebo test",
    "control gathering": "control group",
    "benchmark bunch": "control group",
    "attractive reverberation imaging": "magnetic resonance imaging",
    "attractive reverberance imaging": "magnetic resonance imaging",
    "processed tomography": "computed tomography",
    "figured tomography": "computed tomography",
    "x-beam": "X-ray",
    "bright imaging": "fluorescence imaging",
    "diabetes mellitus sort 2": "diabetes mellitus type 2",
    "coronary illness": "heart disease",
    "cardiovascular breakdown": "heart failure",
    "pneumonic embolism": "pulmonary embolism",
    "region under the bend": "area under the curve",
    "zone under the bend": "area under the curve",
    "collector working trademark": "receiver operating characteristic",
    "beneficiary working trademark": "receiver operating characteristic",
    "collector working trademark bend": "ROC curve",
    "affirmation coefficient": "correlation coefficient",
    "connection coefficient": "correlation coefficient",
    "relapse investigation": "regression analysis",
    "relapse examination": "regression analysis",
    "straight relapse": "linear regression",
    "calculated relapse": "logistic regression",
    "strategic relapse": "logistic regression",
    "strategic regression": "logistic regression",
    "chi-square examination": "chi-square test",
    "standard deviation esteem": "standard deviation value",
    "measurable importance": "statistical significance",
    "factual importance": "statistical significance",
    "factual significance": "statistical significance",
    "invalid speculation": "null hypothesis",
    "void theory": "null hypothesis",
    "writing audit": "literature review",
    "writing survey": "literature review",
    "orderly survey": "systematic review",
    "efficient survey": "systematic review",
    "meta examination": "meta-analysis",
    "meta-investigation": "meta-analysis",
    "cross-sectional examination": "cross-sectional study",
    "partner study": "cohort study",
    "forthcoming investigation": "prospective study",
    "educated assent": "informed consent",
    "moral endorsement": "ethical approval",
    "moral board": "ethics board",
}

# Section names in their standard order, and other names for them.
SECTIONS = ["introduction", "methods", "results", "discussion", "conclusion"]
SECTION_NAMES = {
    "background": "introduction",
    "materials and methods": "methods",
    "methodology": "methods",
    "experimental": "methods",
    "study design": "methods",
    "statistical analysis": "methods",
    "findings": "results",
    "experimental results": "results",
    "outcomes": "results",
    "limitations": "discussion",
    "conclusions": "conclusion",
    "summary": "conclusion",
}

# Words in the headings of methods sections.
METHODS_HEADINGS = ["methods", "methodology", "materials and methods", "experimental", "study design", "statistical analysis", "data collection", "participants", "procedures"]

# Patterns of stock sentences, matched in lower case.
STOCK_SENTENCES = [
    r"in this study,? we (?:propose|present|develop|introduce|investigate)",
    r"the (?:results|findings) (?:show|indicate|demonstrate|suggest|reveal) that",
    r"to the best of our knowledge",
    r"in recent years,? .{10,60} has (?:attracted|received|gained) .{5,30} attention",
    r"(?:plays|play) an? (?:important|crucial|vital|significant|key|essential) role",
    r"has been widely (?:used|applied|adopted|studied|investigated)",
    r"with the (?:rapid|fast) development of",
    r"has (?:become|emerged as) (?:a |an )?(?:hot|popular|important|promising)",
    r"(?:provides|provided|offering) a (?:new|novel|promising|effective) (?:approach|method|framework|strategy)",
    r"(?:however|nevertheless),? (?:there (?:are|is)|it) (?:still|remains?) (?:some|several|many|a number of) (?:challenges|limitations|problems|issues)",
    r"the proposed (?:method|approach|framework|model|algorithm) (?:outperforms|achieves|shows)",
    r"(?:compared|comparison) with (?:other|existing|traditional|state-of-the-art|previous) (?:methods|approaches)",
    r"the experimental results (?:demonstrate|show|indicate|verify|validate)",
    r"(?:first|firstly),? .{10,80}(?:second|secondly),? .{10,80}(?:third|thirdly)",
    r"(?:is|are) summarized in (?:table|fig)",
    r"as shown in (?:table|fig|figure)",
]

# Openings of an abstract's sentences by role, in the order in which roles are tried.
SENTENCE_ROLES = {
    "background": r"^(?:in recent|with the|the |over the past|currently|nowadays)",
    "objective": r"^(?:this study|in this|we (?:aim|propose|present|develop)|the (?:aim|purpose|objective))",
    "methods": r"^(?:we (?:use|used|employ|collect|train|applied|develop)|a total of|data (?:were|was)|the dataset)",
    "results": r"^(?:the results|our (?:results|method|model|approach)|the (?:proposed|accuracy|AUC|performance))",
    "conclusion": r"^(?:(?:in )?conclusion|the (?:proposed|study)|our (?:findings|results) (?:suggest|indicate|demonstrate)|this (?:study|work))",
}

# Discourse markers and characteristic phrases of generated text, as whole words.
DISCOURSE = [
    "furthermore", "moreover", "notably", "specifically", "importantly", "additionally", "in particular", "it is worth noting", "it should be noted",
    "it is important to note", "overall", "in summary", "conversely", "nevertheless", "nonetheless", "in contrast", "significantly", "subsequently",
    "correspondingly", "interestingly", "remarkably",
]
GENERATED = [
    "delve into", "tapestry of", "multifaceted", "located at the intersection of", "it'?s important to acknowledge", "underscores the importance",
    "pivotal role", "landscape of", "paradigm shift", "in the realm of", "holistic approach", "unprecedented", "groundbreaking", "comprehensive overview",
    "robust framework", "critical juncture", "navigate the complex", "shed light on", "paves the way", "remains to be seen",
]

# Reasons of retraction that point to fabrication, and topic patterns of the labelled papers.
FRAUD_REASONS = [
    "Concerns/Issues About Data", "Fabrication/Falsification of Data", "Fabrication/Falsification of Images", "Fake Peer Review", "Manipulation of Images",
    "Manipulation of Results", "Paper Mill", "Concerns/Issues About Image Integrity", "Unreliable Data", "Concerns/Issues About Referencing/Attributions",
    "Duplication of Article", "Plagiarism of Data",
]
TOPICS = [
    "deep learning", "machine learning", "artificial intelligence", "neural network", "convolutional", "random forest", "support vector", "image classification",
    "image segmentation", "natural language processing", "prediction model", "predictive model", "diagnostic model", "prognostic model", "automated detection",
    "computer.aided", "feature extraction", "XGBoost", "LSTM", "transformer", "GAN", "U-?Net", "ResNet", "VGG", "BERT",
]

# Journals left out by the sensitivity analysis without one publisher.
EXCLUDED_JOURNALS = [
    "Computational Intelligence and Neuroscience", "Security and Communication Networks", "Wireless Communications and Mobile Computing",
    "Journal of Healthcare Engineering", "Journal of Sensors", "Contrast Media", "BioMed Research International", "Computational and Mathematical Methods in Medicine",
    "Scientific Programming", "Mobile Information Systems", "Journal of Intelligent", "Disease Markers", "Evidence-Based Complementary", "Oxidative Medicine",
    "Complexity", "Mathematical Problems in Engineering", "Journal of Environmental and Public Health", "Applied Bionics and Biomechanics",
    "Journal of Food Quality", "International Transactions on Electrical Energy Systems", "Discrete Dynamics in Nature and Society",
]

# The world health region of each country, the regions' names, and the income group of countries.
COUNTRY_REGIONS = {
    "DZ": "AFR", "AO": "AFR", "BJ": "AFR", "BW": "AFR", "BF": "AFR", "BI": "AFR", "CV": "AFR", "CM": "AFR", "CF": "AFR", "TD": "AFR", "KM": "AFR", "CG": "AFR",
    "CD": "AFR", "CI": "AFR", "GQ": "AFR", "ER": "AFR", "SZ": "AFR", "ET": "AFR", "GA": "AFR", "GM": "AFR", "GH": "AFR", "GN": "AFR", "GW": "AFR", "KE": "AFR",
    "LS": "AFR", "LR": "AFR", "MG": "AFR", "MW": "AFR", "ML": "AFR", "MR": "AFR", "MU": "AFR", "MZ": "AFR", "NA": "AFR", "NE": "AFR", "NG": "AFR", "RW": "AFR",
    "ST": "AFR", "SN": "AFR", "SC": "AFR", "SL": "AFR", "ZA": "AFR", "SS": "AFR", "TG": "AFR", "UG": "AFR", "TZ": "AFR", "ZM": "AFR", "ZW": "AFR",
    "AG": "AMR", "AR": "AMR", "BS": "AMR", "BB": "AMR", "BZ": "AMR", "BO": "AMR", "BR": "AMR", "CA": "AMR", "CL": "AMR", "CO": "AMR", "CR": "AMR", "CU": "AMR",
    "DM": "AMR", "DO": "AMR", "EC": "AMR", "SV": "AMR", "GD": "AMR", "GT": "AMR", "GY": "AMR", "HT": "AMR", "HN": "AMR", "JM": "AMR", "MX": "AMR", "NI": "AMR",
    "PA": "AMR", "PY": "AMR", "PE": "AMR", "KN": "AMR", "LC": "AMR", "VC": "AMR", "SR": "AMR", "TT": "AMR", "US": "AMR", "UY": "AMR", "VE": "AMR",
    "BD": "SEAR", "BT": "SEAR", "KP": "SEAR", "IN": "SEAR", "ID": "SEAR", "MV": "SEAR", "MM": "SEAR", "NP": "SEAR", "LK": "SEAR", "TH": "SEAR", "TL": "SEAR",
    "AL": "EUR", "AD": "EUR", "AM": "EUR", "AT": "EUR", "AZ": "EUR", "BY": "EUR", "BE": "EUR", "BA": "EUR", "BG": "EUR", "HR": "EUR", "CY": "EUR", "CZ": "EUR",
    "DK": "EUR", "EE": "EUR", "FI": "EUR", "FR": "EUR", "GE": "EUR", "DE": "EUR", "GR": "EUR", "HU": "EUR", "IS": "EUR", "IE": "EUR", "IL": "EUR", "IT": "EUR",
    "KZ": "EUR", "KG": "EUR", "LV": "EUR", "LT": "EUR", "LU": "EUR", "MT": "EUR", "MC": "EUR", "ME": "EUR", "NL": "EUR", "MK": "EUR", "NO": "EUR", "PL": "EUR",
    "PT": "EUR", "MD": "EUR", "RO": "EUR", "RU": "EUR", "SM": "EUR", "RS": "EUR", "SK": "EUR", "SI": "EUR", "ES": "EUR", "SE": "EUR", "CH": "EUR", "TJ": "EUR",
    "TR": "EUR", "TM": "EUR", "UA": "EUR", "GB": "EUR", "UZ": "EUR",
    "AF": "EMR", "BH": "EMR", "DJ": "EMR", "EG": "EMR", "IR": "EMR", "IQ": "EMR", "JO": "EMR", "KW": "EMR", "LB": "EMR", "LY": "EMR", "MA": "EMR", "OM": "EMR",
    "PK": "EMR", "PS": "EMR", "QA": "EMR", "SA": "EMR", "SO": "EMR", "SD": "EMR", "SY": "EMR", "TN": "EMR", "AE": "EMR", "YE": "EMR",
    "AU": "WPR", "BN": "WPR", "KH": "WPR", "CN": "WPR", "CK": "WPR", "FJ": "WPR", "JP": "WPR", "KR": "WPR", "LA": "WPR", "MY": "WPR", "MH": "WPR", "FM": "WPR",
    "MN": "WPR", "NR": "WPR", "NZ": "WPR", "NU": "WPR", "PW": "WPR", "PG": "WPR", "PH": "WPR", "WS": "WPR", "SG": "WPR", "SB": "WPR", "TO": "WPR", "TV": "WPR",
    "VU": "WPR", "VN": "WPR", "TW": "WPR",
}
REGION_NAMES = {
    "AFR": "African Region",
    "AMR": "Region of the Americas",
    "SEAR": "South-East Asia Region",
    "EUR": "European Region",
    "EMR": "Eastern Mediterranean Region",
    "WPR": "Western Pacific Region",
}
COUNTRY_INCOMES = {
    "US": "HIC", "GB": "HIC", "DE": "HIC", "JP": "HIC", "AU": "HIC", "CA": "HIC", "FR": "HIC", "IT": "HIC", "KR": "HIC", "NL": "HIC", "SE": "HIC", "CH": "HIC",
    "DK": "HIC", "NO": "HIC", "FI": "HIC", "SG": "HIC", "IL": "HIC", "NZ": "HIC", "AT": "HIC", "BE": "HIC", "IE": "HIC", "ES": "HIC", "PT": "HIC", "CZ": "HIC",
    "PL": "HIC", "SA": "HIC", "AE": "HIC", "QA": "HIC", "KW": "HIC", "BH": "HIC", "TW": "HIC",
    "CN": "UMIC", "BR": "UMIC", "MX": "UMIC", "TR": "UMIC", "MY": "UMIC", "TH": "UMIC", "ZA": "UMIC", "CO": "UMIC", "RU": "UMIC", "AR": "UMIC", "IR": "UMIC", "IQ": "UMIC",
    "RO": "UMIC", "KZ": "UMIC",
    "IN": "LMIC", "PK": "LMIC", "BD": "LMIC", "VN": "LMIC", "EG": "LMIC", "NG": "LMIC", "PH": "LMIC", "ID": "LMIC", "KE": "LMIC", "GH": "LMIC", "NP": "LMIC", "LK": "LMIC",
    "MA": "LMIC", "TN": "LMIC", "MM": "LMIC", "ET": "LMIC",
}
REGIONS = ["AFR", "AMR", "EMR", "EUR", "SEAR", "WPR", "Unknown"]
INCOMES = ["HIC", "UMIC", "LMIC", "LIC", "Unknown"]
