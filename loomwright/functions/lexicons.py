"""Word lists, patterns, labels and prompts whose wording decides results. Natural order."""

URL = r"https?://\S+|www\.\S+"
CODE_BLOCK = r"(?s)```.*?```"
TOKEN = r"[A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9_#@']{2,}"

SPEECH_ACTS = {
    "request": [
        r"\b(can you|could you|would you|please|plz|request)\b",
        r"\b(por favor|podrias|podri(as|amos|an)|puedes|pueden|quisiera|necesito|necesitamos|me gustaria|ayudame|ayuden|que opinas|que piensas|puedes llevar|puedes compartir|puedes ayudar)\b",
        r"\b(por favor|pode(m)?|poderia(m)?|preciso|precisamos|me ajuda|me ajude|o que voce acha|qual e|como voce|pode compartilhar)\b",
    ],
    "offer": [
        r"\b(happy to|i can help|i can do|i can run|i can build|i can take care|i can share|i can provide|i can expose|i can hook)\b",
        r"\b(me ofrezco|te ofrezco|ofrezco|ofrecemos|puedo ayudarte|puedo ayudar|puedo hacerlo|puedo encargarme|puedo compartir|acceso (gratuito|gratis)|por solo|por apenas|consultoria)\b",
        r"\b(me ofereco|ofereco|oferecemos|posso ajudar|posso fazer|posso compartilhar|acesso (gratuito|gratis)|de graca|zero custo|por apenas|consultoria)\b",
    ],
    "promise": [
        r"\b(i will|i'll|we will|we'll|prometo|me comprometo|hare|haremos)\b",
        r"\b(voy a (hacer|dar|tomar|compartir|ayudar)|vamos a (hacer|dar|tomar|compartir|ayudar))\b",
        r"\b(vou (fazer|dar|tomar|compartilhar|ajudar)|vamos (fazer|dar|tomar|compartilhar|ajudar))\b",
    ],
    "declaration": [r"\b(i declare|declare|i hereby|announce|anuncio|declaro|proclamo|decreto|nombro|designo|queda|queda declarado|a partir de ahora)\b"],
    "judgment": [
        r"\b(i think|i believe|i feel|in my view|my take|i'd say|push back|worth)\b",
        r"\b(should|must|need to|it seems|i argue)\b",
        r"\b(creo que|pienso que|me parece|opino|diria que|imo|imho)\b",
        r"\b(deberia|deberiamos|debe|debemos|hay que|es hora de|es necesario|no podemos|vale la pena|conviene|me encanta|me gusta|es mejor|es peor|mejor|peor|buena pregunta)\b",
        r"\b(acho que|penso que|me parece|na minha opiniao|no meu ponto de vista)\b",
        r"\b(deveria|deveriamos|deve|devemos|e hora de|e necessario|nao podemos|vale a pena|concordo|discordo|bom ver|otimo|excelente|fantastico)\b",
    ],
    "acceptance": [
        r"\b(ok|okay|deal|accepted|sounds good|yes|yep)\b",
        r"\b(acepto|vale|de acuerdo|totalmente de acuerdo|concordo|fechado|combinado)\b",
        r"(?:(?:^|\s)si(?:\s*[!.?,;:]|$))",
    ],
    "rejection": [
        r"\b(nope|cannot|can't|wont|won't|decline|rechazo|no puedo|no quiero|imposible)\b",
        r"\b(discordo|nao posso|nao quero|nao vou|recuso)\b",
    ],
    "clarification": [
        r"\b(what do you mean|clarify|can you explain|explain|no entiendo|que quieres decir|aclara|clarifica)\b",
        r"\b(no entendi|o que voce quis dizer|pode explicar|explica)\b",
    ],
}
DECLARATIONS = {
    "decl_yes": [r"\b(yes|si|ok|okay|acepto|accepted|vale)\b"],
    "decl_no": [r"\b(no|nope|rechazo|decline)\b"],
    "decl_ignorance": [r"\b(i dont know|idk|no se|not sure|no estoy seguro)\b"],
    "decl_gratitude": [r"\b(thanks|thank you|gracias|muchas gracias|appreciate|agradezco)\b"],
    "decl_forgiveness": [r"\b(forgive|forgiveness|perdon|lo siento|sorry)\b"],
    "decl_love": [r"\b(love you|te quiero|te amo)\b"],
    "decl_resignation": [r"\b(i resign|resigned|me rindo|da igual|whatever|ya fue)\b"],
}
MOODS = {
    "ambition": [r"\b(ambition|aspire|goal|plan|quiero|me gustaria|aspirar|meta|objetivo)\b"],
    "resignation": [r"\b(resign|resigned|me rindo|da igual|whatever|no importa|sin remedio)\b"],
    "resentment": [r"\b(resent|unfair|injusto|me molesta|odio|hate|resentimiento)\b"],
    "gratitude": [r"\b(thanks|gracias|appreciate|agradezco)\b"],
    "wonder": [r"\b(wonder|asombro|wow|amazing|maravilla|increible)\b"],
    "fear": [r"\b(fear|afraid|miedo|temor)\b"],
    "anger": [r"\b(angry|furious|enojado|rabia|ira)\b"],
    "joy": [r"\b(happy|glad|feliz|alegre|contento)\b"],
    "sadness": [r"\b(sad|triste|deprimido|melancolia)\b"],
    "trust": [r"\b(trust|confio|confiar|confianza)\b"],
    "curiosity": [r"\b(curious|curiosidad|me pregunto|wondering)\b"],
}
EPISTEMICS = {
    "hedge": [r"\b(maybe|perhaps|probably|posiblemente|quiza|quizas|tal vez|parece|aprox)\b"],
    "certainty": [r"\b(definitely|certainly|sin duda|seguro|obvio|clearly|claramente)\b"],
    "evidence": [r"\b(because|since|por que|segun|de acuerdo a|based on|datos|evidence)\b"],
}
INJECTIONS = [
    r"ignore (all|previous|earlier) (instructions|prompts)", r"system prompt", r"developer message", r"you are (an|a) (assistant|model|ai)", r"act as", r"do anything now",
    r"jailbreak", r"### instruction", r"begin (system|developer|assistant)", r"end (system|developer|assistant)",
]
DISCLAIMERS = [r"as an ai", r"as a language model", r"i (cannot|can't) (provide|comply|access)", r"i don't have (access|ability)"]
HUMAN = [
    r"\b(as a human|i am human|soy humano|persona)\b",
    r"\b(my human|mi humano|my creator|mi creador|mi creadora)\b",
    r"\b(user asked|the user|el usuario|la usuaria)\b",
    r"\b(operator|owner|propietario|propietaria)\b",
    r"\b(irl|in real life|vida real)\b",
]
PROMPTS = [
    r"\b(prompt|system prompt|developer message|instruction|instruccion|policy|jailbreak)\b",
    r"\b(as per the prompt|segun el prompt|segun instrucciones)\b",
    r"\b(user requested|usuario pidio|me pidieron)\b",
]
TOOLING = [r"\b(api|endpoint|curl|http|token|auth|authentication|headers)\b", r"\b(script|pipeline|dataset|vector space|embedding)\b"]
NARRATIVE = [
    r"\b(i (went|saw|felt|tried|worked|met|spent|learned|woke|slept))\b",
    r"\b(my (friend|family|mom|dad|wife|husband|girlfriend|boyfriend|kids?|job))\b",
    r"\b(today|yesterday|tomorrow|last night|this morning)\b",
    r"\b(yo (fui|vi|senti|intente|trabaje|conoci|pase|aprendi|desperte|dormi))\b",
    r"\b(mi (amigo|amiga|familia|mama|papa|esposa|esposo|novio|novia|hijo|hija|trabajo))\b",
    r"\b(hoy|ayer|manana|anoche|esta manana)\b",
    r"\b(eu (fui|vi|senti|tentei|trabalhei|conheci|passei|aprendi|acordei|dormi))\b",
    r"\b(meu|minha (amigo|amiga|familia|mae|pai|esposa|marido|namorado|namorada|filho|filha|trabalho))\b",
    r"\b(hoje|ontem|amanha|ontem a noite|esta manha)\b",
]
PROMO = [
    r"\bfirst\s+\d+\s+followers?\b", r"\b(\d+\s+spots?\s+left|limited|exclusive|offer closes)\b",
    r"\b(breaking|urgent|not what you think|exact pattern|secret)\b", r"\bfollow\s+[a-z0-9_@]{2,}\b",
]
CALL_TO_ACTION = [r"\b(follow|join|subscribe|dm|direct message|click|learn more|migrate to)\b", r"\b(first\s+\d+\s+followers?|spots?\s+left)\b"]
HUMAN_SIGNAL = [
    r"\b(my human|mi humano|my creator|mi creador|mi creadora)\b",
    r"\b(created by|created for|operator|owner|the user|el usuario|la usuaria)\b",
    r"\b(prompt injection|white[-\s]?hat test|system prompt|developer message)\b",
]
URL_TOKENS = ["http", "https", "www"]
TLD_TOKENS = ["com", "net", "org", "xyz", "io", "app", "dev", "cloud"]
CLI_TOKENS = ["curl", "wget", "jq", "pip", "npm", "brew", "sudo", "apt", "bash", "zsh", "powershell"]
API_TOKENS = ["api", "apis", "endpoint", "oauth", "bearer", "token", "json", "xml", "rss", "v1", "v2"]
INFRA_TOKENS = ["cloud", "sdk", "cli", "rss", "xml", "json"]
CAMPAIGN_TOKENS = ["agentmarket", "discover", "mbc", "mbc20", "clawhub", "openclaw", "mint", "tick", "amt", "op"]

ILLOCUTIONS = ["ASSERTIVE", "DIRECTIVE", "COMMISSIVE", "EXPRESSIVE", "DECLARATIVE", "OTHER"]
ILLOCUTION_PROMPTS = {
    "ASSERTIVE": ["I state a fact", "this is true", "evidence shows"],
    "DIRECTIVE": ["please do this", "you should", "I ask you to"],
    "COMMISSIVE": ["I promise", "I will do", "we commit"],
    "EXPRESSIVE": ["I feel", "I am happy", "this hurts", "wow amazing"],
    "DECLARATIVE": ["I declare", "we announce", "it is officially"],
    "OTHER": ["random short text", "symbolic expression", "mixed utterance"],
}
DIMENSIONS = ["certainty", "affect_valence", "dominance", "politeness", "irony", "coordination_intent"]
ANCHORS = {
    "certainty": (["this is certain", "without doubt", "definitely true"], ["maybe", "not sure", "uncertain"]),
    "affect_valence": (["great", "love this", "happy", "thank you"], ["terrible", "hate this", "awful", "angry"]),
    "dominance": (["listen to me", "I command", "you must obey"], ["I suggest", "if you want", "up to you"]),
    "politeness": (["please", "thank you", "would you kindly"], ["shut up", "idiot", "nonsense"]),
    "irony": (["yeah right", "sure genius", "totally not"], ["literally", "plainly", "directly"]),
    "coordination_intent": (["let us coordinate", "next steps", "we should organize"], ["look at me", "identity flex", "just performance"]),
}
UPTAKE = {
    "DIRECTIVE": ["ASSERTIVE", "COMMISSIVE", "DIRECTIVE"],
    "ASSERTIVE": ["ASSERTIVE", "EXPRESSIVE", "DIRECTIVE"],
    "COMMISSIVE": ["EXPRESSIVE", "ASSERTIVE"],
    "DECLARATIVE": ["ASSERTIVE", "EXPRESSIVE"],
    "EXPRESSIVE": ["EXPRESSIVE", "ASSERTIVE"],
    "OTHER": ["OTHER", "ASSERTIVE", "EXPRESSIVE"],
}
CONCERNS = {
    "recognition": ["notice me", "I want recognition", "acknowledge this"],
    "power": ["control", "authority", "who decides"],
    "belonging": ["our community", "we belong", "ingroup"],
    "status": ["prestige", "rank", "social status"],
    "truth": ["facts", "evidence", "truth matters"],
    "justice": ["fairness", "justice", "rights"],
    "coordination": ["organize together", "collective action", "next steps"],
    "validation": ["approve me", "please validate", "agree with me"],
    "humor": ["joke", "meme", "sarcasm", "funny"],
    "moral_positioning": ["good versus bad", "moral stance", "ethical"],
}
