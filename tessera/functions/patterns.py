"""The indicator patterns and weights of the scorers.

Each pattern comes with the number of values one match yields (the match and
its groups); a list's count is the sum over its patterns that match at all.
"""

SPECIFIC = [
    (r"\b(\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2})\b", 2),
    (r"(?i)\b\d+(\.\d+)?(%|percent|dollars?|years?|months?|days?|hours?|minutes?)\b", 3),
    (r"(?i)\b(according to|cited by|reported by|published in|stated that)\b", 2),
    (r"(?i)\b(specifically|particularly|precisely|exactly|approximately)\b", 2),
    (r"\b([A-Z][a-z]+ [A-Z][a-z]+)\b", 2),
    (r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)* (University|Institute|Corporation|Company|Inc|Ltd)\b", 2),
]
VAGUE = [
    (r"(?i)\b(some|many|several|various|numerous|often|sometimes|usually|generally|typically)\b", 2),
    (r"(?i)\b(thing|stuff|something|anything|everything|nothing|someone|anyone|everyone)\b", 2),
    (r"(?i)\b(probably|maybe|perhaps|possibly|might|could|would|should)\b", 2),
    (r"(?i)\b(seems?|appears?|looks? like|sounds? like)\b", 2),
]
STRUCTURE = [
    (r"(?i)\b(first|second|third|finally|in conclusion|furthermore|moreover|however|therefore)\b", 2),
    (r"(?i)\b(for example|such as|including|namely|specifically)\b", 2),
    (r"[.!?][ \t\n\r]+[A-Z]", 1),
    (r":[ \t\n\r]*[A-Z]", 1),
]
FORMAL = [
    (r"(?i)\b(research|study|analysis|data|evidence|methodology|findings|results)\b", 2),
    (r"(?i)\b(demonstrated|established|indicated|revealed|confirmed|suggested)\b", 2),
    (r"(?i)\b(significant|substantial|considerable|notable|important|crucial)\b", 2),
]
FILLER = r"(?i)\b(just|really|very|quite|rather|somewhat|kind of|sort of|like|you know|I mean)\b"
FACT = r"\b(\d+(\.\d+)?|[A-Z][a-z]+ \d{1,2}, \d{4}|Q\d \d{4}|\d{4}-\d{2}-\d{2})\b"
TRANSITION = r"(?i)\b(however|therefore|furthermore|moreover|consequently|nevertheless|meanwhile|finally|in addition|for example|in contrast|similarly)\b"
PAST, PRESENT = r"\b\w+ed\b", r"(?i)\b(is|are|has|have|does|do)\b"
CONTRAST = r"(?i)\b(but|however|although|despite|nevertheless|nonetheless|on the other hand)\b"
CONTENT_WEIGHTS = {"specificity": 0.3, "completeness": 0.25, "readability": 0.2, "density": 0.15, "coherence": 0.1}

TIERS = {"CANONICAL": 1.0, "REPUTABLE": 0.85, "COMMUNITY": 0.65, "INFORMAL": 0.4}
ACADEMIC = r"(?i)\b(\.edu|\.ac\.|arxiv\.org|pubmed|doi\.org|scholar\.google|jstor|ieee|acm\.org)\b"
GOVERNMENT = r"(?i)\b(\.gov|\.mil|whitehouse\.gov|congress\.gov|europa\.eu|who\.int)\b"
NONPROFIT = r"(?i)\b(\.org|wikipedia\.org|archive\.org|reuters\.org)\b"
SOCIAL = r"(?i)\b(twitter\.com|facebook\.com|instagram\.com|linkedin\.com|tiktok\.com|reddit\.com|medium\.com)\b"
TITLE_BOOSTS = [
    (r"(?i)\b(study|research|analysis|journal|paper|review|findings|data|evidence|methodology|peer[ \t\n\r-]?review)\b", 0.05),
    (r"(?i)\b(official|report|statement|announcement|policy|guidelines|standards|specification)\b", 0.03),
    (r"(?i)\b(shocking|amazing|unbelievable|secret|hidden|exposed|explosive|breaking|urgent|must[ \t\n\r-]?see)\b", -0.05),
    (r"(?i)\b(opinion|editorial|op[ \t\n\r-]?ed|commentary|blog|rant|my[ \t\n\r-]?take)\b", -0.02),
]

#: type: half life and greatest age in days, base score.
DECAY = {"news": (30, 365, 1.0), "academic": (365, 3650, 0.95), "reference": (730, 7300, 0.9), "historical": (1825, 36500, 0.8)}
CONTENT_TYPES = {
    "news": [(r"(?i)\b(breaking|news|report|announced|today|yesterday|this week|this month)\b", 2), (r"(?i)\b(reuters|ap|bbc|cnn|fox|nbc|abc|cbs|guardian|times|post)\b", 2), (r"(?i)\b(press release|statement|announcement|update)\b", 2)],
    "academic": [(r"(?i)\b(study|research|journal|paper|peer[ \t\n\r-]?review|methodology|findings|analysis)\b", 2), (r"(?i)\b(university|institute|professor|dr\.|phd|published|citation)\b", 2), (r"(?i)\b(hypothesis|experiment|data|statistical|correlation|significant)\b", 2)],
    "reference": [(r"(?i)\b(wikipedia|encyclopedia|manual|guide|documentation|specification)\b", 2), (r"(?i)\b(definition|reference|handbook|textbook|standard)\b", 2), (r"(?i)\b(overview|introduction|summary|background)\b", 2)],
    "historical": [(r"(?i)\b(historical|archive|retrospective|timeline|chronology|legacy)\b", 2), (r"(?i)\b(founded|established|originally|traditionally|historically)\b", 2), (r"(?i)\b(decades? ago|years? ago|century|ancient|vintage|classic)\b", 2)],
}
TIMELESS = [(r"(?i)\b(mathematics?|physics?|chemistry|biology|philosophy|logic|ethics)\b", 2), (r"(?i)\b(algorithm|theory|principle|law|theorem|definition|concept)\b", 2), (r"(?i)\b(fundamental|basic|core|essential|universal|eternal)\b", 2)]
FACTUAL = [(r"(?i)\b(fact|data|statistics?|evidence|proof|documentation|record)\b", 2), (r"(?i)\b(according to|based on|cited|referenced|documented|verified)\b", 2), (r"(?i)\b(\d+%|\d+\.\d+|approximately|exactly|precisely)\b", 2)]
OPINION = [(r"(?i)\b(i think|in my opinion|i believe|personally|i feel|arguably|supposedly)\b", 2), (r"(?i)\b(should|ought|must|need to|have to|subjective|bias)\b", 2)]
FRESH = [(r"(?i)\b(breaking|urgent|latest|current|now|today|yesterday|this week)\b", 2), (r"(?i)\b(update|announcement|alert|development|happening)\b", 2), (r"(?i)\b(stock|price|market|trading|earnings|financial)\b", 2), (r"(?i)\b(weather|forecast|emergency|crisis|outbreak)\b", 2)]

#: name: weight, keywords, patterns; all are matched with the text in small letters.
TOPICS = {
    "career": (1.0, ["job", "work", "career", "profession", "employment", "company", "position", "role", "title", "experience"], [r"(?i)\b(worked at|employed by|position at|role as|experience in)\b", r"(?i)\b(software engineer|developer|manager|director|ceo|cto|analyst)\b", r"(?i)\b(years? of experience|background in|specialized in)\b"]),
    "education": (0.9, ["education", "school", "university", "college", "degree", "graduate", "study", "major", "phd", "master"], [r"(?i)\b(graduated from|degree in|studied at|phd in|master of)\b", r"(?i)\b(university|college|institute|school)\b", r"(?i)\b(bachelor|master|doctorate|phd|mba)\b"]),
    "skills": (0.8, ["skill", "ability", "expertise", "proficient", "experienced", "knowledge", "competent", "capable"], [r"(?i)\b(skilled in|expertise in|proficient at|experienced with)\b", r"(?i)\b(programming|coding|development|design|analysis|management)\b", r"(?i)\b(python|javascript|react|aws|machine learning|data science)\b"]),
    "personal": (0.6, ["interests", "hobbies", "passion", "enjoys", "likes", "loves", "personal", "family", "married"], [r"(?i)\b(interested in|passionate about|enjoys|hobby|personal interest)\b", r"(?i)\b(married to|spouse|partner|children|family)\b", r"(?i)\b(travels|sports|music|reading|cooking|photography)\b"]),
    "achievements": (0.7, ["award", "recognition", "achievement", "accomplishment", "success", "winner", "published", "patent"], [r"(?i)\b(won|awarded|recognized|achieved|accomplished)\b", r"(?i)\b(published|authored|patent|invention|breakthrough)\b", r"(?i)\b(first place|winner|champion|excellence)\b"]),
}
FIELDS = {
    "name": (1.0, ["name", "called", "known as", "mr", "ms", "dr"], [r"\b([A-Z][a-z]+ [A-Z][a-z]+)\b", r"(?i)\b(known as|called|name is|named)\b"]),
    "jobTitle": (0.9, ["title", "position", "role", "job", "works as", "employed as"], [r"(?i)\b(software engineer|developer|manager|director|analyst|consultant)\b", r"(?i)\b(works as|employed as|position of|title of|role as)\b"]),
    "company": (0.9, ["company", "organization", "firm", "corporation", "startup", "works at"], [r"(?i)\b(works at|employed by|company|corporation|inc|ltd|llc)\b", r"(?i)\b(Google|Microsoft|Amazon|Apple|Facebook|Meta|Netflix|Tesla)\b"]),
    "education": (0.8, ["education", "degree", "university", "college", "graduated", "studied"], [r"(?i)\b(graduated from|degree in|studied at|university|college)\b", r"(?i)\b(bachelor|master|phd|mba|bs|ms|ba|ma)\b"]),
    "location": (0.7, ["location", "lives", "based", "from", "city", "state", "country"], [r"(?i)\b(lives in|based in|from|located in|resides in)\b", r"\b([A-Z][a-z]+, [A-Z][A-Z]|[A-Z][a-z]+, [A-Z][a-z]+)\b"]),
}
CONTEXTS = {
    "professional": (0.9, [r"(?i)\b(work|job|career|professional|business|corporate|company|office)\b", r"(?i)\b(meeting|project|team|client|deadline|presentation|budget)\b", r"(?i)\b(strategy|leadership|management|development|innovation)\b"]),
    "educational": (0.8, [r"(?i)\b(education|academic|school|university|college|study|research)\b", r"(?i)\b(learn|knowledge|understanding|analysis|theory|practice)\b", r"(?i)\b(course|curriculum|degree|certification|training)\b"]),
    "personal": (0.6, [r"(?i)\b(personal|family|home|private|individual|self|own)\b", r"(?i)\b(hobby|interest|passion|enjoy|like|love|prefer)\b", r"(?i)\b(weekend|vacation|travel|leisure|entertainment)\b"]),
    "social": (0.5, [r"(?i)\b(social|community|friends|network|relationship|group)\b", r"(?i)\b(volunteer|charity|cause|organization|society|club)\b", r"(?i)\b(event|gathering|conference|meetup|party|celebration)\b"]),
}
TERMS = [r"\b[A-Z]{2,}\b", r"\b\d+(\.\d+)?[a-zA-Z]+\b", r"\b[a-z]+\.[a-z]+\.[a-z]+\b", r"\b[A-Z][a-z]+[A-Z][a-z]+\b", r"\b\w+@\w+\.\w+\b", r"\bhttps?://[^ \t\n\r]+\b"]
NEGATION = r"(?i)\b(?:not|never|no|isn't|wasn't|didn't|won't|can't|doesn't)[ \t\n\r]+"
RELATED_DOMAINS = [("cnn.com", "edition.cnn.com"), ("bbc.com", "bbc.co.uk"), ("reuters.com", "reuters.org"), ("nytimes.com", "nyti.ms"), ("washingtonpost.com", "wapo.st"), ("theguardian.com", "guardian.co.uk")]
SYNDICATED = [r"(?i)\b(AP|Reuters|Bloomberg|Associated Press)\b", r"(?i)\b(syndicated|wire service|news service)\b", r"(?i)\b(originally published|first published|republished)\b"]
