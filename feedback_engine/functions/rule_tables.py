"""Rules of the tagger, terms and themes: fixed values, which results depend on. Other tables are a parameter of every operator (enrich.load_rules)."""

from __future__ import annotations

#: The tags of negative feedback and the patterns that give them.
NEGATIVE = {
    "Cheaters & Hackers": [
        r"\bcheat(?:er|s|ing)?\b",
        r"\bhack(?:er|s|ing|ed)?\b",
        r"\baimbot\b",
        r"\bwallhack\b",
        r"\bwall\s*hack\b",
        r"\bcronus\b",
        r"\bzen\b.*cronus|cronus.*\bzen\b",
        r"\bчит(?:ер|еры|ы|)\b",
        r"\bхак(?:ер|еры)?\b",
        r"\bаимбот\b",
        r"\bвх\b",
        r"\bexploit(?:s|ing|er)?\b",
    ],
    "Matchmaking & SBMM": [
        r"\bmatchmak(?:ing|er)\b",
        r"\bsbmm\b",
        r"\bmmr\b",
        r"\bskill.based.match",
        r"\bunfair.match",
        r"matched.*(higher|better|sweaty|pro|level\s*\d)",
        r"(higher|better).*(level|rank|player).*match",
        r"\bstomp(?:ed|ing|s)?\b",
        r"\bsmurf(?:s|ing)?\b",
        r"\bподбор\b.*игрок",
        r"\bбаланс\b.*команд",
        r"\bматчмейк\b",
        r"\bсбмм\b",
        r"lobby.*(sweat|tryhard|try.hard)",
        r"\btop\s*500\b",
        r"\bruby\b.*player",
        r"against.*(top|best|highest|pro)\s*(player|rank|level)",
        r"(?:casual|unranked).*(?:sweat|tryhard|try.hard|pro|top.500)",
        r"\bкидают?\b.*(?:к|про|могут|высок)",
        r"\bсбмм\b.*(?:нет|отсутств)",
        r"\bранг\w*\b.*(?:высок|низк|дисбаланс)",
        r"\bпопущ\w*\b",
    ],
    "Weapon & Class Balance": [
        r"\bunbalanc(?:ed|e)\b",
        r"\bimbalanc(?:ed|e)\b",
        r"\b(?:op|overpowered)\b.*(?:melee|sword|katana|knife|dagger|hammer|rpg|flamethrower|flame|shotgun|smg|minigun)",
        r"(?:melee|sword|katana|knife|dagger|hammer|rpg|flamethrower|flame|shotgun).*\b(?:op|overpowered|broken|cheese|ridiculous|ruin)\b",
        r"\bmelee\b.*(?:beat|kill|one.?shot|2.?shot|two.?shot|broken|op\b|overpower|ridiculous)",
        r"\bbalance\b",
        r"\bбаланс\b",
        r"\bnerfs?\b",
        r"\bbuffs?\b",
        r"(?:heavy|light|medium).*(?:broken|op\b|overpowered|imbalance|unbalance|useless|bother)",
        r"\bclass\b.*(?:imbalanc|unbalanc|broken|unfair)",
        r"\bone.?shot\b.*(?:broken|op|weapon|kill|unfair)",
        r"\bsword[s]?\b.*(?:ruin|broken|op|hate|remove|stupid|disgust)",
        r"\bdagger[s]?\b.*(?:ruin|broken|op|hate|remove)",
        r"\binvis(?:ible|ibility)?\b.*(?:broken|op|stupid|unfair|hate|cheese)",
        r"\bпушк\w*\b.*(?:горох|дисбаланс|имба|оп\b)",
        r"\bимб\w+\b",
        r"\bодин\w*\b.*(?:класс|пушк)",
        r"\bгорох\w*\b",
    ],
    "Performance & Optimization": [
        r"\bfps\b",
        r"\boptimi[sz](?:ation|ed|e)\b",
        r"\bstutter(?:s|ing)?\b",
        r"\bscreen.?tear(?:ing)?\b",
        r"\bframe.?(?:rate|drop|s)\b",
        r"\brun[s]?\s+(?:like|bad|terrible|awful|poor|crap|shit|trash)",
        r"\bслайдшоу\b",
        r"\bоптимизац\b",
        r"\bфриз\b",
        r"\bтормоз(?:ит|а|ы)?\b",
        r"\bhigh.?(?:temp|cpu|gpu)",
        r"\b\d+\s*°",
        r"\bslideshow\b",
        r"\bплохая оптимизация\b",
        r"\bмыльн\w+\b",
    ],
    "Network & Servers": [
        r"\bpacket.?loss\b",
        r"\brubber.?band(?:ing)?\b",
        r"\bdesync\b",
        r"\bnetcode\b",
        r"\bnet\s*code\b",
        r"\b(?:server|network).?(?:lag|issue|problem|error|crash|disconnect)",
        r"\bdisconnect(?:ed|ing|s|ion)?\b",
        r"\blag(?:s|gy|ging|ged)?\b",
        r"\bping\b.*(?:high|bad|terrible|spike)",
        r"\blatency\b",
        r"\bлаг(?:и|ает|ов)?\b",
        r"\bпинг\b",
        r"\bunable.to.sync\b",
        r"\bconnect(?:ing)?\s*screen\b",
        r"\bразрыв\w*\b",
        r"\bрегистрац\w*\b.*попадан",
    ],
    "Anti-cheat & False Bans": [
        r"\bfalse.?ban\b",
        r"\bbanned?\b.*(?:no.?reason|unfair|unjust|false|innocent|nothing|wrong)",
        r"(?:no.?reason|unfair|unjust|false|innocent|nothing|wrong).*\bbanned?\b",
        r"\banti.?cheat\b.*(?:broken|bad|garbage|terrible|trash|awful)",
        r"\bпермач\b",
        r"\bзабанили\b",
        r"\bзабан\w*\b",
        r"\bблокировк\w*\b",
        r"\bbanned?\b.*\bcheating\b.*(?:never|didn|don|not|no)",
        r"\bfalse(?:ly)?\s*(?:ban|accus|flag|perman)",
        r"\bbanned?\b.*(?:permanent|perma)",
        r"\bban(?:ned)?\b.*(?:for nothing|wrongly|wrongful|without reason)",
        r"\bsuspend(?:ed)?\b.*(?:account|unfair|no reason|unjust)",
        r"\bban\b.*(?:модификац|reason)",
        r"\banticheat\b",
        r"\banticheater?\b",
    ],
    "Customer Support": [
        r"\bsupport\b.*(?:bad|terrible|awful|garbage|trash|useless|ignore|no.help|bot.response|doesn.t.help|won.t.help|automat|copy.paste)",
        r"\bтехподдержк\w*\b",
        r"\bтп\b.*(?:не отвечает|игнор)",
        r"\bticket\b.*(?:ignore|no.response|bot|automat|copy.paste)",
        r"\bembark\b.*(?:ignore|doesn.t.care|don.t.care|not.help|won.t)",
        r"\bcopy.?paste\b.*(?:response|support|reply)",
        r"\bautomated\b.*(?:response|reply|support)",
        r"\bbot\s*response\b",
    ],
    "TTK (Time to Kill)": [
        r"\bttk\b",
        r"\btime.to.kill\b",
        r"\b(?:full|whole|entire)\s*mag(?:azine)?\b",
        r"\btoo\s+(?:long|much|many)\s+(?:to\s+)?kill\b",
        r"\bbullet.?spong(?:e|y)\b",
        r"\bтткш\b",
        r"\bубить\b.*(?:долго|невозможно)",
        r"\bhigh\s+ttk\b",
        r"\bтtk\b",
        r"\bтtк\b",
        r"\bклип\b.*(?:не хватает|кончает|мало)",
        r"\brun\s*out\s*of\s*(?:ammo|clip|mag)\b",
    ],
    "Teammates & Solo Experience": [
        r"\bteammate[s]?\b.*(?:bad|awful|terrible|braindead|brain.dead|trash|useless|worst|garbage|stupid|lobotom)",
        r"(?:bad|awful|terrible|braindead|brain.dead|trash|useless).*\bteammate",
        r"\bsolo\b.*(?:unplayable|impossible|terrible|bad|awful|can.t|don.t|suck)",
        r"\bno\s+teammate[s]?\b",
        r"\bleaver[s]?\b",
        r"\bleaving\b.*(?:match|game|mid)",
        r"\bdon.?t\s+have\s+(?:a\s+)?(?:team|friend|squad|group)\b",
        r"\bwithout\s+(?:a\s+)?(?:team|friend|squad|premade)\b",
        r"\bneed\s+(?:a\s+)?(?:team|friend|squad|premade|3)\b.*\bdon.t\b",
        r"\bunless\s+you\s+have\s+(?:two|2|three|3)\s+friend",
        r"\bплохие\s+(?:тиммейт|союзник|напарник)\b",
    ],
    "Developer Direction": [
        r"\barc.?raiders?\b",
        r"\bdev(?:s|eloper)?.*(?:don.t care|doesn.t care|abandon|neglect|busy|focus|gave up|lazy|incompeten|lost|ruin|kill)",
        r"\bembark\b.*(?:don.t care|doesn.t care|abandon|neglect|gave up|killed|ruin|incompeten)",
        r"\bразраб\w*\b.*(?:забива|плев|забил|бросил|не.делают|убил)",
        r"\bdead.?game\b.*dev",
        r"\bonly\b.*(?:skin|cosmetic|shop|store).*(?:update|add|new|content)",
        r"\bno\s+(?:real\s+)?(?:update|content|new)\b",
        r"\bтольк\w*\b.*(?:скин|магазин|шоп|фантик)",
    ],
    "Game Design & Modes": [
        r"\bcashout\b.*(?:bad|broken|stupid|unfair|terrible|mess|hate|suck|steal)",
        r"\bvault\b.*(?:steal|stolen|last.second|unfair|stupid|broken)",
        r"\bgame.?mode[s]?\b.*(?:bad|boring|stale|lack|limited|stupid|terrible)",
        r"\bovertime\b",
        r"\bpowershift\b.*(?:bad|boring|terrible|stupid|hate)",
        r"\brepetiti(?:ve|ous)\b",
        r"\bбатл\s*пас\b.*(?:копипаст|одинаков)",
    ],
    "Crashes & Bugs": [
        r"\bcrash(?:es|ed|ing)?\b",
        r"\bbug(?:s|gy)?\b",
        r"\bfreez(?:e[s]?|ing)\b",
        r"\berror\b.*(?:code|system|crash|integrity)",
        r"\bкраш\b",
        r"\bбаг(?:и|ов)?\b",
        r"\bcan.t.rejoin\b",
        r"\bsettings?\s*reset\b",
        r"\bглюч\b",
        r"\bbroken\b.*(?:replay|system|menu|UI)",
        r"\bошибк\w+\b",
        r"\bне\s*(?:удается|могу)\s*зайти\b",
    ],
    "Low Playerbase": [
        r"\bdead\s*game\b",
        r"\bdying\s*game\b",
        r"\bno\s*(?:one|body)\s*play(?:s|ing)?\b",
        r"\bplayer.?(?:count|base)\b.*(?:low|dead|dying|drop|declin)",
        r"\bonline\b.*(?:dead|dying|мертв)",
        r"\bмертв\b",
        r"\bонлайн\b.*(?:мертв|низк|нет)",
        r"\bno\s*wonder\s*no\s*(?:one|body|1)\b",
        r"\bgame\b.*\bdi(?:ed|ying)\b",
    ],
    "Monetization": [
        r"\bpay.?to.?win\b",
        r"\bp2w\b",
        r"\bbattle.?pass\b.*(?:bad|greedy|expensive|awful|terrible|worst|scam|ridiculous|overpriced)",
        r"\bmicrotransaction[s]?\b.*(?:bad|greedy|expensive|predatory|awful)",
        r"\b(?:skin|cosmetic)s?\b.*(?:expensive|overpriced|greedy|predatory|ridiculous|absurd|pricing|pric)",
        r"\bmonetiz\w+\b.*(?:bad|greedy|predatory|awful|terrible)",
        r"\bдонат\b",
        r"\bpredatory\b",
        r"\bfomo\b",
        r"\boverpriced\b",
        r"\bбатл\s*пас\b.*(?:цен|дорог|грабеж)",
    ],
    "Visibility & Chaos": [
        r"\bvisib(?:ility|le)\b.*(?:bad|terrible|awful|trash|poor|can.t see|zero|no)",
        r"\bcan.t\s+see\b",
        r"\bwhere\b.*\bwho\b",
        r"\btoo\s+(?:chaotic|much\s+chaos)\b",
        r"\bхаос\b",
        r"\bне\s*видно\b",
        r"\bclutter\b",
    ],
    "New Player Experience": [
        r"\bnew\s*player\b.*(?:bad|terrible|hostile|hard|rough|steep|unfriendly|punish)",
        r"\blearning\s*curve\b",
        r"\bconfus(?:ing|ed)\b",
        r"\bsteep\b.*\bcurve\b",
        r"\bnoob\b.*(?:unfriendly|hostile|punish)",
        r"\bpunish(?:ing)?\b.*(?:new|beginn|noob|start)",
        r"\bdon.t\s+have\s+all\s+(?:the\s+)?(?:gun|weapon|gadget|unlock)",
    ],
    "Denuvo / DRM": [
        r"\bdenuvo\b",
        r"\bdrm\b",
        r"\bkernel\b.*(?:anti|driver|level)",
        r"\bзащит\w*\b.*(?:denuvo|drm)",
    ],
}

#: The tags of positive feedback and the patterns that give them.
POSITIVE = {
    "Fun & Addictive": [
        r"\bfun\b",
        r"\baddic(?:ting|tive|ted)\b",
        r"\benjoy(?:able|ed|ing|s)?\b",
        r"\blove\b.*(?:game|this|it|play)",
        r"\bblast\b",
        r"\bкайф\b",
        r"\bлюбим\b",
        r"\bdopamine\b",
        r"\bserotonin\b",
        r"\bcan.t\s+stop\b",
        r"\bfav(?:orite|ourite)\b",
        r"\b(?:so|very|really|super|insanely|incredibly)\s+good\b",
        r"\bamazing\s+game\b",
        r"\bgreat\s+game\b",
        r"\bgood\s+game\b",
        r"\bpretty\s+good\b",
        r"\bbest\s+(?:fps|shooter|game)\b",
        r"\b(?:10|9|8)\/10\b",
        r"\b(?:10|9|8)\s+out\s+of\s+10\b",
        r"\bpeak\b(?:\s+game|\s+fps|\s+shooter)?",
        r"\bвесёл\w+\b",
        r"\bвесел\w+\b",
        r"\bкруто\b",
        r"\bтоп\b",
        r"\bбомб\w*\b",
        r"\bлучш\w+\b.*(?:игр|шутер|fps)",
        r"\brecommend\b",
    ],
    "Destructible Environment": [
        r"\bdestruct(?:ible|ion|ive)\b",
        r"\bdestr(?:oy|oying)\b.*(?:environ|building|wall|floor|map|everything)",
        r"\beverything\b.*\b(?:destroy|break|destruct)\b",
        r"\bразруш\w+\b",
        r"\bphysics\b",
    ],
    "Unique / Fresh FPS": [
        r"\bunique\b",
        r"\bfresh\b",
        r"\bno\s+other\b.*(?:game|fps|shooter)",
        r"\bnothing\s+(?:like|else)\b",
        r"\bdifferent\b.*(?:fps|shooter|game)",
        r"\brefresh(?:ing)?\b",
        r"\bуникальн\w+\b",
        r"\bnext.?gen\b",
        r"\bone\s+of\s+a\s+kind\b",
        r"\boriginal\b",
        r"\binnovati(?:ve|on|ng)\b",
        r"\bинновац\w+\b",
        r"\bиниваци\w+\b",
        r"\bslept\s+on\b",
    ],
    "Movement & Fluidity": [
        r"\bmovement\b.*(?:great|good|amazing|best|smooth|fluid|clean|insane|incredible|fast|cool)",
        r"(?:great|good|amazing|best|smooth|fluid|clean|insane|incredible).*\bmovement\b",
        r"\bfluid\b",
        r"\bfast.?paced\b",
        r"\bдинамик\w+\b",
        r"\bдинамичн\w+\b",
        r"\bшустр\w+\b",
    ],
    "Gunplay": [
        r"\bgunplay\b",
        r"\bgun[s]?\b.*(?:feel|great|good|satisf|clean|tight|snappy|responsive)",
        r"\bshooting\b.*(?:feel|great|good|satisf|clean|tight)",
        r"\bweapon[s]?\b.*(?:feel|great|good|satisf|balanc)",
        r"\brecoil\b.*(?:good|satisf|fair)",
        r"\baim\b.*(?:great|satisf|reward)",
        r"\bстрельб\w+\b.*(?:хорош|круто|кайф|отлич)",
    ],
    "Graphics & Visuals": [
        r"\bgraphic[s]?\b.*(?:great|good|amazing|beautiful|stunning|incredible|best|gorgeous|nice)",
        r"(?:great|good|amazing|beautiful|stunning|incredible|gorgeous).*\bgraphic",
        r"\bvisual(?:s|ly)?\b.*(?:great|good|amazing|beautiful|stunning|incredible)",
        r"\bграфик\w+\b.*(?:отлич|хорош|круто|ахуен|красив)",
        r"\bbeautiful\b",
        r"\bstunning\b",
        r"\bgorgeous\b",
        r"\bsound\s*design\b",
    ],
    "Free-to-Play Value": [
        r"\bfree\b.*(?:play|great|good|amazing|worth|can.t.believe|baffles|crazy|game)",
        r"\bf2p\b",
        r"\bfree.?to.?play\b",
        r"\bno\s+pay.?to.?win\b",
        r"\bnot\s+p2w\b",
        r"\bit.s\s+free\b",
    ],
    "Game Modes": [
        r"\bgame\s*mode[s]?\b.*(?:great|good|fun|amazing|interesting|varied|different|cool)",
        r"\bcashout\b.*(?:great|good|fun|cool|interesting|love)",
        r"\bmode[s]?\b.*(?:great|good|fun|really|variety|different)",
        r"\bрежим\w*\b.*(?:интересн|круто|хорош)",
    ],
    "Teamwork": [
        r"\bteamwork\b",
        r"\bteam.?play\b",
        r"\bteam\b.*(?:matter|key|important|great|fun|work|focus)",
        r"\bwith\s+friends?\b",
        r"\bкоманд\w+\b.*(?:игр|важн|шутер)",
        r"\bс\s+друзь\w+\b",
    ],
    "Customization & Skins": [
        r"\bcustomi[sz](?:ation|able|e)\b",
        r"\bskin[s]?\b.*(?:great|good|cool|amazing|best|top|nice|awesome|crazy|lut)",
        r"\bcosmetic[s]?\b.*(?:great|good|cool|amazing|best)",
        r"\bскин\w*\b.*(?:топ|круто|хорош|лют)",
        r"\bкастомизац\w*\b",
        r"\bкосметик\w*\b",
    ],
    "Good Performance": [
        r"\brun[s]?\b.*(?:great|good|well|smooth|fine|perfect|solid)",
        r"\boptimi[sz](?:ed|ation)\b.*(?:great|good|well)",
        r"\bwell.?optimi[sz]ed\b",
        r"\bsmooth\b",
        r"\bperformance\b.*(?:great|good|solid|smooth|rock)",
        r"\bоптимизир\w+\b.*(?:хорош|отлич)",
        r"\bхорош\w*\b.*оптимизир",
    ],
    "Fair Monetization": [
        r"\bbattle.?pass\b.*(?:great|good|worth|fair|generous|best|value|awesome|stupid.?good|amazing)",
        r"\bnot\b.*\bpay.?to.?win\b",
        r"\bfair\b.*\bmonetiz\b",
        r"\b(?:earn|free)\b.*\bpremium\b",
        r"\bmultibucks?\b",
        r"\bmicrotransaction[s]?\b.*(?:not|fair|good|great|reasonable)",
    ],
    "Dynamic & Chaotic": [
        r"\bchaos\b",
        r"\bchaotic\b",
        r"\bdynamic\b",
        r"\bevery\s+(?:match|game)\b.*\bdifferent\b",
        r"\bnever\s+(?:the\s+)?same\b",
        r"\bхаос\b",
        r"\bэкшон\b",
        r"\bэкшн\b",
        r"\bсдвг\b",
    ],
    "Class & Gadget System": [
        r"\bgadget[s]?\b.*(?:great|good|cool|fun|amazing|interesting)",
        r"\bclass(?:es)?\b.*(?:great|good|cool|fun|interesting|varied|different)",
        r"\b(?:heavy|light|medium)\b.*(?:great|fun|cool|unique|love)",
        r"\babilit(?:y|ies)\b.*(?:great|good|cool|fun|unique|interesting)",
        r"\bloadout[s]?\b",
        r"\bplaystyle[s]?\b",
    ],
    "Strategic Depth": [
        r"\bstrateg(?:y|ic|ical)\b",
        r"\bnot\s+just\s+(?:aim|shoot|reflex)",
        r"\bcreativ(?:e|ity)\b",
        r"\bthink(?:ing)?\b.*(?:required|needed|matters|game)",
        r"\bbrain\b.*(?:required|needed|use)",
        r"\bskill\s*(?:gap|ceiling)\b",
    ],
    "Underrated": [
        r"\bunderrated\b",
        r"\bunderappreciat\w+\b",
        r"\bdeserve[s]?\s+more\b",
        r"\bhidden\s+gem\b",
        r"\bcriminally\b",
        r"\bнедооценен\w*\b",
        r"\bslept\s+on\b",
    ],
}

#: Terms that are counted, and their patterns.
TERMS = {
    "dead game": r"\bdead\s*game\b",
    "dead": r"\bdead\b",
    "playerbase": r"\bplayer\s*base\b",
    "population": r"\bpopulation\b",
    "queue time / wait time": r"\b(?:queue|wait)\s*(?:time|times)\b",
    "long queue": r"\b(?:long|forever)\s*(?:queue|wait|matchmak)\b",
    "game is dying": r"\bgame\b.*\b(?:dying|di(?:ed|es))\b",
    "region lock": r"\bregion\s*lock\b",
    "china / chinese": r"\b(?:china|chinese)\b",
    "asia": r"\basia(?:n)?\b",
    "vpn": r"\bvpn\b",
    "crossplay": r"\bcross\s*play\b",
    "console": r"\bconsole\b",
    "controller": r"\bcontroller\b",
    "pc": r"\bpc\b",
    "aim assist": r"\baim\s*assist\b",
    "mouse": r"\bmouse\b",
    "keyboard": r"\bkeyboard\b",
    "ps4 / ps5": r"\bps[45]\b",
    "xbox": r"\bxbox\b",
    "content": r"\bcontent\b",
    "update": r"\bupdate[s]?\b",
    "new map": r"\bnew\s*map[s]?\b",
    "lack of content": r"\b(?:lack|no|missing)\b.*\bcontent\b",
    "stale": r"\bstale\b",
    "boring": r"\bboring\b",
    "repetitive": r"\brepetiti(?:ve|ous)\b",
    "nothing new": r"\bnothing\s*new\b",
    "same thing": r"\bsame\s*thing\b",
    "ttk": r"\bttk\b",
    "time to kill": r"\btime\s*to\s*kill\b",
    "bullet sponge": r"\bbullet\s*spong[ey]\b",
    "spongey / spongy": r"\bspong[ey]\b",
    "sbmm": r"\bsbmm\b",
    "skill based": r"\bskill\s*based\b",
    "matchmaking": r"\bmatchmak(?:ing|er)\b",
    "sweaty / sweat": r"\bsweat(?:y|s|ing)?\b",
    "tryhard": r"\btry\s*hard[s]?\b",
    "solo": r"\bsolo\b",
    "solo queue": r"\bsolo\s*queue\b",
    "friends": r"\bfriend[s]?\b",
    "team": r"\bteam\b",
    "duo": r"\bduo[s]?\b",
    "f2p / free to play": r"\b(?:f2p|free\s*to\s*play)\b",
    "pay / paid": r"\b(?:pay|paid)\b",
    "skin / skins": r"\bskin[s]?\b",
    "cosmetic": r"\bcosmetic[s]?\b",
    "battle pass": r"\bbattle\s*pass\b",
    "season": r"\bseason\b",
    "shop / store": r"\b(?:shop|store)\b",
    "overpriced": r"\boverpriced\b",
    "nerf": r"\bnerf(?:ed|s|ing)?\b",
    "buff": r"\bbuff(?:ed|s|ing)?\b",
    "patch": r"\bpatch(?:es)?\b",
    "meta": r"\bmeta\b",
    "op / overpowered": r"\b(?:op|overpowered)\b",
    "broken": r"\bbroken\b",
    "fun": r"\bfun\b",
    "addictive": r"\baddic(?:ting|tive|ted)\b",
    "unique": r"\bunique\b",
    "original": r"\boriginal\b",
    "potential": r"\bpotential\b",
    "disappointing": r"\bdisappoint(?:ing|ed|ment)?\b",
    "frustrating": r"\bfrustrat(?:ing|ed|ion)?\b",
    "annoying": r"\bannoying\b",
    "AI / bot": r"\b(?:ai\b|bots?\b)",
    "announcer": r"\bannouncer\b",
    "voice / audio": r"\b(?:voice|audio)\b",
    "tos / terms of service": r"\b(?:tos|terms\s*of\s*service)\b",
    "abandon / leave / quit": r"\b(?:abandon|leav(?:e|ing)|quit(?:ting)?)\b",
    "uninstall": r"\buninstall(?:ed|ing)?\b",
    "refund": r"\brefund(?:ed|ing)?\b",
    "trash": r"\btrash\b",
    "garbage": r"\bgarbage\b",
    "worst": r"\bworst\b",
    "ruined": r"\bruin(?:ed|ing|s)?\b",
    "toxic": r"\btoxic(?:ity)?\b",
    "grind": r"\bgrind(?:ing|y)?\b",
    "progression": r"\bprogression\b",
    "rank / ranked": r"\brank(?:ed|s|ing)?\b",
    "casual": r"\bcasual\b",
    "competitive": r"\bcompetitiv(?:e|ely)\b",
    "tournament": r"\btournament[s]?\b",
    "esport": r"\besport[s]?\b",
    "linux": r"\blinux\b",
    "steam deck": r"\bsteam\s*deck\b",
    "anti-cheat (general)": r"\banti\s*cheat\b",
    "easy anti-cheat / eac": r"\b(?:eac|easy\s*anti\s*cheat)\b",
    "sound / music": r"\b(?:sound(?:track)?|music)\b",
    "map / maps": r"\bmap[s]?\b",
    "destroy / destruction": r"\b(?:destroy|destruction|destructi(?:ble|on))\b",
    "steal / stolen": r"\b(?:steal(?:ing)?|stolen)\b",
    "third party": r"\bthird\s*part(?:y|ies)\b",
    "invest": r"\binvest(?:ed|ment|ing)?\b",
    "wasted": r"\bwast(?:e[ds]?|ing)\b",
    "nostalgia / old version": r"\b(?:nostalgia|old\s*version|beta\s*was\s*better|used\s*to\s*be)\b",
    "early access / beta": r"\b(?:early\s*access|beta|alpha)\b",
}

#: Themes looked for in feedback without a tag, and their patterns.
THEMES = {
    "Dead game / low playerbase / dying": [
        r"\bdead\s*game\b",
        r"\bgame\b.*\b(?:dying|di(?:ed|es))\b",
        r"\bplayer\s*(?:count|base)\b.*(?:low|dead|dying|drop|declin|shrink)",
        r"\bno\s*(?:one|body)\b.*\bplay\b",
        r"\bdying\b",
        r"\bgame\s*is\s*dead\b",
        r"\b(?:low|empty|dead)\s*(?:server|lobby|lobbies|queue)\b",
        r"\blong\s*(?:queue|wait|matchmak)\b",
        r"\bcan.?t\s*find\s*(?:a\s*)?(?:match|game|lobby|player)\b",
    ],
    "Region lock / China / VPN": [
        r"\bregion\s*lock\b",
        r"\bchina\b.*(?:cheat|hack|lag|ruin|player|flood|invad)",
        r"\bchinese\b.*(?:cheat|hack|player|server)",
        r"\bvpn\b",
        r"\bregion\b.*(?:lock|block|restrict|limit|separ)",
    ],
    "Crossplay / console vs PC / aim assist": [
        r"\bcross\s*play\b",
        r"\baim\s*assist\b",
        r"\bconsole\b.*\bpc\b",
        r"\bpc\b.*\bconsole\b",
        r"\bcontroller\b.*(?:advantage|unfair|aimbot|aim\s*assist|broken|op)",
        r"\bmouse\b.*\bcontroller\b",
        r"\bcontroller\b.*\bmouse\b",
        r"\binput\s*(?:method|type|based)\b",
    ],
    "Content drought / lack of updates / maps": [
        r"\b(?:lack|no|missing|need|want)\b.*\bcontent\b",
        r"\b(?:lack|no|missing|need|want)\b.*\b(?:new\s*)?map[s]?\b",
        r"\b(?:lack|no|missing)\b.*\bupdate[s]?\b",
        r"\bnothing\s*new\b",
        r"\bsame\s*(?:thing|map|mode|stuff)\b.*(?:over|again|repeat)",
        r"\bstale\b",
        r"\bgets?\s*(?:old|boring|repetitive|stale)\b",
        r"\bneed\s*(?:more|new)\s*(?:content|map|mode|weapon|gun)\b",
    ],
    "TTK complaints (in unclassified)": [
        r"\bttk\b",
        r"\btime\s*to\s*kill\b",
        r"\bbullet\s*spong[ey]\b",
        r"\bspong[ey]\b",
        r"\btoo\s*(?:many|much)\s*(?:health|hp|hit)\b",
        r"\b(?:takes?|need)\s*(?:too\s*)?(?:long|forever|many\s*(?:bullet|shot|hit))\s*(?:to\s*)?kill\b",
    ],
    "SBMM complaints (in unclassified)": [
        r"\bsbmm\b",
        r"\bskill\s*based\s*match\b",
        r"\bmmr\b",
        r"\bsweaty?\b.*(?:lobby|match|game)",
        r"\btryhard\b",
    ],
    "Controller vs mouse / input fairness": [
        r"\bcontroller\b.*(?:advantage|unfair|broken|op|aimbot|aim\s*assist)",
        r"\baim\s*assist\b.*(?:broken|op|unfair|strong|ridiculous|insane)",
        r"\binput\b.*(?:fair|unfair|balance|advantage)",
        r"\bm[&n]?k\b.*\bcontroller\b",
        r"\bcontroller\b.*\bm[&n]?k\b",
    ],
    "Toxic / griefing / team sabotage": [
        r"\btoxic(?:ity)?\b",
        r"\bgrief(?:er|ing|s)?\b",
        r"\btroll(?:ing|s|er)?\b",
        r"\bteam\s*kill(?:ing|er|ed)?\b",
        r"\bsabotag(?:e|ing)\b",
        r"\bthrow(?:ing|er|s)?\b.*(?:game|match)",
        r"\bafk\b",
    ],
    "Linux / Steam Deck / OS compatibility": [
        r"\blinux\b",
        r"\bsteam\s*deck\b",
        r"\bproton\b",
        r"\bwindows\s*only\b",
        r"\b(?:os|operating\s*system)\b.*(?:support|compat)",
    ],
    "Nostalgia / game was better before": [
        r"\bused\s*to\s*be\b.*(?:good|great|fun|better|amazing)",
        r"\bbeta\b.*(?:was|were)\s*(?:better|good|more\s*fun)",
        r"\b(?:season\s*[012]|s[012])\b.*(?:was|were)\s*(?:better|good|fun|peak)",
        r"\bthey\s*(?:ruined|changed|killed|destroyed)\b",
        r"\bnot\s*(?:the\s*)?same\s*game\b",
        r"\bgame\b.*(?:changed|different).*(?:worse|bad|not\s*fun)",
    ],
    "Frustrating / not fun anymore": [
        r"\bfrustrat(?:ing|ed|ion)\b",
        r"\bannoying\b",
        r"\bnot\s*fun\b",
        r"\bno\s*(?:longer|more)\s*fun\b",
        r"\bstopped?\s*(?:being|having)\s*fun\b",
        r"\b(?:unfun|un-fun)\b",
        r"\bstress(?:ful|ing)?\b",
        r"\brage\s*(?:quit|inducing|game)?\b",
    ],
    "Wasted potential": [
        r"\bpotential\b",
        r"\bwast(?:ed|ing)\s*potential\b",
        r"\bcould\s*(?:be|have\s*been)\s*(?:so\s*much\s*)?(?:great|good|better|amazing)\b",
        r"\bgreat\s*(?:concept|idea)\b.*(?:but|however|poor|bad)",
        r"\b(?:good|great)\s*(?:game|concept)\b.*\bbut\b",
    ],
    "Stealing mechanic frustration": [
        r"\bsteal(?:ing)?\b.*(?:frustrat|annoy|unfair|stupid|broken|bs|bullshit|hate)",
        r"\blast\s*(?:second|minute)\b.*\bsteal\b",
        r"\bstolen\b.*(?:vault|cashout|cash|win|game|match)",
        r"\bthird\s*part(?:y|ied|ies)\b",
        r"\b3rd\s*party\b",
    ],
}
