"""Tables of the canonicaliser."""

# They decide results and are stated in their natural order.

#: whole text -> canonical text, as written
OVERRIDES = {
    "Light Class: overpowered": "Light: overpowered",
    "Heavy Class: overpowered": "Heavy: overpowered",
    "Medium Class: overpowered": "Medium: overpowered",
    "Light Class: underpowered": "Light: underpowered",
    "Heavy Class: underpowered": "Heavy: underpowered",
    "Medium Class: underpowered": "Medium: underpowered",
    "Add: more game modes": "Add: more modes",
    "Add: new game modes": "Add: more modes",
    "Content: needs more game modes": "Add: more modes",
    "Content: needs more modes": "Add: more modes",
    "Game Modes: needs more": "Add: more modes",
    "Game Modes: needs more variety": "Add: more modes",
    "Content: needs more maps": "Add: more maps",
    "Content: needs more weapons": "Add: more weapons",
    "Add: new weapons": "Add: more weapons",
    "Content: needs more": "Add: more content",
    "Content: needs more updates": "Add: more content",
    "Content: needs more content": "Add: more content",
    "Content: game feels stale": "Add: more content",
    "Fix: anti-cheat": "Fix: anti-cheat",
    "Anti-cheat: ineffective": "Anti-cheat: ineffective",
    "Add: localization for Russian": "Add: Russian localization",
    "Add: Russian language": "Add: Russian localization",
    "Add: Russian localization": "Add: Russian localization",
}
#: lower-case topic -> canonical topic
PREFIXES = {
    "light class": "Light",
    "light class op": "Light",
    "light class issues": "Light",
    "heavy class": "Heavy",
    "heavy class op": "Heavy",
    "heavy class issues": "Heavy",
    "medium class": "Medium",
    "medium class op": "Medium",
    "medium class issues": "Medium",
    "game design direction": "Game design",
    "game design": "Game design",
    "game mode": "Game modes",
    "game modes": "Game modes",
    "game mode complaints": "Game modes",
    "movement & combat feel": "Movement",
    "movement & feel": "Movement",
    "cheating & anti-cheat": "Cheating",
    "server performance & connectivity": "Servers",
    "server": "Servers",
    "server performance": "Servers",
    "bugs & technical issues": "Bugs",
    "bugs": "Bugs",
    "bug": "Bugs",
    "technical issues": "Bugs",
    "performance & optimization": "Performance",
    "performance": "Performance",
    "optimization": "Performance",
    "weapon imbalance": "Weapon balance",
    "weapon balance": "Weapon balance",
    "gadget imbalance": "Gadget balance",
    "gadget balance": "Gadget balance",
    "matchmaking issues": "Matchmaking",
    "content drought": "Content",
    "player behavior & toxicity": "Player behavior",
    "player behavior": "Player behavior",
    "players": "Player behavior",
    "monetization & battle pass": "Monetization",
    "monetization": "Monetization",
    "battle pass": "Monetization",
    "crossplay & input balance": "Crossplay",
    "crossplay": "Crossplay",
    "teamwork & coordination": "Teamwork",
    "teamwork": "Teamwork",
    "audio & sound design": "Audio",
    "audio": "Audio",
    "sound & music": "Audio",
    "sound": "Audio",
    "graphics & visuals": "Graphics",
    "visuals": "Graphics",
    "free-to-play value": "F2P",
    "free-to-play": "F2P",
    "f2p model": "F2P",
    "destructible environments": "Destruction",
    "environment destruction": "Destruction",
    "class system & abilities": "Class system",
    "class system": "Class system",
    "weapon & gadget variety": "Weapon variety",
    "weapon variety": "Weapon variety",
    "region lock & china": "Region lock",
    "region lock": "Region lock",
    "region": "Region lock",
    "linux / steam deck": "Linux",
    "linux": "Linux",
    "steam deck": "Linux",
    "progression & rank resets": "Progression",
    "progression": "Progression",
    "rank": "Ranked",
    "map design": "Maps",
    "maps": "Maps",
    "map": "Maps",
    "revive & respawn mechanics": "Respawn",
    "revive": "Respawn",
    "respawn": "Respawn",
    "spawn points": "Spawns",
    "spawn": "Spawns",
    "terms of service": "ToS",
    "tos": "ToS",
    "third-partying": "Third-partying",
    "third partying": "Third-partying",
    "third party": "Third-partying",
    "ai voice acting": "AI voices",
    "ai voice": "AI voices",
    "ai voices": "AI voices",
    "low playerbase": "Playerbase",
    "playerbase": "Playerbase",
    "dead game": "Playerbase",
    "3v3v3v3 format": "3v3v3v3",
    "game balance": "Game balance",
    "balance": "Game balance",
    "account": "Account",
}
#: lower-case description -> canonical description
SUFFIXES = {
    "chaotic and fun": "chaotic",
    "chaotic fun": "chaotic",
    "fun chaos": "chaotic",
    "pure chaos": "chaotic",
    "fun and addictive": "fun and addictive",
    "beautiful": "beautiful",
    "looks great": "beautiful",
    "looks good": "beautiful",
    "good looking": "beautiful",
    "well polished": "beautiful",
    "stunning": "beautiful",
    "gorgeous": "beautiful",
    "pretty": "beautiful",
    "good visuals": "beautiful",
    "visually appealing": "beautiful",
    "good feel": "satisfying",
    "feels great": "satisfying",
    "feels good": "satisfying",
    "well done": "satisfying",
    "terrible": "bad",
    "awful": "bad",
    "horrible": "bad",
    "garbage": "bad",
    "trash": "bad",
    "worst": "bad",
    "poor": "bad",
    "atrocious": "bad",
    "abysmal": "bad",
    "too strong": "overpowered",
    "op": "overpowered",
    "needs nerf": "overpowered",
    "no skill required": "overpowered",
    "no skill": "overpowered",
    "too weak": "underpowered",
    "useless": "underpowered",
    "needs buff": "underpowered",
    "nerfed": "underpowered",
    "overnerfed": "underpowered",
    "nerfed too hard": "underpowered",
    "weak": "underpowered",
    "unfun": "unfun",
    "not fun": "unfun",
    "boring": "unfun",
    "stale": "unfun",
    "tedious": "unfun",
    "no counterplay": "no counterplay",
    "uncounterable": "no counterplay",
    "no counter": "no counterplay",
    "can't counter": "no counterplay",
    "lag": "high latency",
    "laggy": "high latency",
    "lags": "high latency",
    "lagging": "high latency",
    "latency": "high latency",
    "ping": "high latency",
    "high ping": "high latency",
    "rubber banding": "high latency",
    "crash": "crashes",
    "crashing": "crashes",
    "unstable": "crashes",
    "game crashes": "crashes",
    "game keeps crashing": "crashes",
    "frequent crashes": "crashes",
    "game crash": "crashes",
    "keeps crashing": "crashes",
    "constant crashes": "crashes",
    "disconnect": "disconnects",
    "disconnecting": "disconnects",
    "kicked": "disconnects",
    "connection issues": "disconnects",
    "game won't launch": "won't launch",
    "game not launching": "won't launch",
    "won't start": "won't launch",
    "doesn't launch": "won't launch",
    "not launching": "won't launch",
    "can't launch": "won't launch",
    "hackers": "too many cheaters",
    "hacker": "too many cheaters",
    "rampant": "too many cheaters",
    "full of cheaters": "too many cheaters",
    "infested": "too many cheaters",
    "cheater": "too many cheaters",
    "cheaters": "too many cheaters",
    "cheaters everywhere": "too many cheaters",
    "ineffective anti-cheat": "ineffective",
    "anti-cheat ineffective": "ineffective",
    "anti-cheat is ineffective": "ineffective",
    "no anti-cheat": "ineffective",
    "aimbot": "aimbots",
    "banned unfairly": "unfair ban",
    "banned for no reason": "unfair ban",
    "banned without reason": "unfair ban",
    "falsely banned": "unfair ban",
    "wrongly banned": "unfair ban",
    "false bans": "unfair ban",
    "false ban": "unfair ban",
    "unfair ban": "unfair ban",
    "banned": "banned",
    "unbalanced teams": "skill disparity",
    "unfair teams": "skill disparity",
    "needs more maps": "needs more maps",
    "needs more modes": "needs more modes",
    "needs more game modes": "needs more modes",
    "needs more weapons": "needs more weapons",
    "needs more content": "needs more content",
    "needs more updates": "needs more content",
    "needs more": "needs more content",
    "game feels stale": "needs more content",
    "lack of content": "needs more content",
    "not enough content": "needs more content",
    "poorly optimized": "poor optimization",
    "unoptimized": "poor optimization",
    "not optimized": "poor optimization",
    "fps drops": "low FPS",
    "frame drops": "low FPS",
    "low fps": "low FPS",
    "fps issues": "low FPS",
    "frame rate drops": "low FPS",
    "slow": "too slow",
    "sluggish": "too slow",
    "janky": "clunky",
    "feels clunky": "clunky",
    "buggy": "too many",
    "too many bugs": "too many",
    "lots of bugs": "too many",
    "localization for russian": "Russian localization",
    "russian language": "Russian localization",
    "russian localization": "Russian localization",
    "russian subtitles": "Russian localization",
}
#: descriptions that say "good" in a word of their own
PRAISE = ("enjoyable", "great", "amazing", "excellent", "awesome", "love it", "the best", "fantastic", "incredible", "wonderful", "brilliant")
FUN = ("Gameplay", "Game modes", "3v3v3v3 Format", "Cashout", "Power Shift", "Quick Cash", "Bank It", "Terminal Attack", "Team Deathmatch", "Head2Head", "Point Break", "Ranked Cashout", "Light", "Medium", "Heavy", "Class system")
SATISFYING = ("Gunplay", "Movement", "Destruction", "Audio")
BEAUTIFUL = ("Graphics",)
GOOD = ("Performance", "F2P", "Weapon variety", "Teamwork")
UNEVEN, UNEVEN_TOPICS = ("unbalanced", "unfair"), ("Matchmaking",)
ANNOYING = ("annoying to play against", "frustrating to play against", "cancer", "unfun to play against")
COMBAT = ("Light", "Medium", "Heavy", "Sword", "Cloaking Device", "Mesh Shield", "Dome Shield", "RPG", "Throwing Knives", "Stun Gun", "Glitch Grenade", "Thermal Vision", "APS Turret", "Barricade", "C4", "Goo Gun", "Goo Grenade", "Pyro Grenade", "Smoke Grenade", "Gateway", "Winch Claw", "Charge 'N' Slam", "Dual Blades", "Third-partying", "Gadget balance")
