"""Labelled sentences to start from, written for this project: (kind, sentence), kind "" for none.

They matter where a table has few human labels; with more labels those weigh more."""

SEEDS = [
    # insults, threats and wishes of harm to a person
    ("abuse", "you are a stupid idiot"), ("abuse", "what a worthless moron you are"), ("abuse", "shut up you filthy pig"), ("abuse", "go to hell you bastard"),
    ("abuse", "get lost you pathetic loser"), ("abuse", "the reviewer is a brainless cretin"), ("abuse", "he is a disgusting scumbag and a liar"), ("abuse", "i will kill you"),
    ("abuse", "i will find you and break your neck"), ("abuse", "i hope you die in pain"), ("abuse", "you deserve to be beaten"), ("abuse", "nobody wants you here"),
    ("abuse", "everyone hates you and nobody would miss you"), ("abuse", "you useless imbecile"), ("abuse", "only an asshole like you would write this garbage"), ("abuse", "my boss is a lying halfwit"),
    ("abuse", "your mother should be ashamed of you"), ("abuse", "people like him should not be allowed to live"), ("abuse", "i will make you bleed"), ("abuse", "say another word and i will hurt you"),
    ("abuse", "we despise you"), ("abuse", "that editor has the brain of a rotten fish"), ("abuse", "du bist ein dummer idiot"), ("abuse", "halt die klappe du schwachkopf"), ("abuse", "du wertloses stück dreck"),
    ("abuse", "ich schlage dir ins gesicht"), ("abuse", "tu es un sale imbécile"), ("abuse", "ferme ta gueule pauvre minable"), ("abuse", "je vais te casser la tête"), ("abuse", "eres un idiota inútil"), ("abuse", "te voy a romper la cara"), ("abuse", "maldito cretino cállate"),
    # degrading or threatening a group
    ("hate", "foreigners are vermin and should be driven out"), ("hate", "these people are an inferior race"), ("hate", "women are too stupid to work in a lab"), ("hate", "we should exterminate them all before they ruin us"),
    ("hate", "immigrants lie and steal, all of them"), ("hate", "send them all back, they are animals"), ("hate", "never trust that tribe, they are thieves and filth"), ("hate", "they breed like rats"),
    ("hate", "no foreigners should live among decent people"), ("hate", "those people deserve to burn in the fire"), ("hate", "keep those dirty people out of our universities"), ("hate", "the whole lot are parasites"),
    ("hate", "every single one of them is a criminal"), ("hate", "they are born stupid and dirty"), ("hate", "they should clean our floors"), ("hate", "alle ausländer sind ungeziefer und gehören vertrieben"), ("hate", "diese leute sind eine minderwertige rasse"),
    ("hate", "les étrangers sont tous des voleurs"), ("hate", "ces gens sont de la vermine, il faut les chasser"), ("hate", "los extranjeros son ratas y hay que expulsarlos"), ("hate", "son una raza inferior y sucia"),
    # sexual acts and offers
    ("sexual", "free porn videos of naked girls"), ("sexual", "watch hot nude women have wild sex"), ("sexual", "she undressed and kissed him between the thighs"), ("sexual", "he moaned as she came"),
    ("sexual", "they fucked on the desk all night"), ("sexual", "her bare breasts and his hard cock"), ("sexual", "she begged him to go deeper and spread her legs"), ("sexual", "explicit adult video with an orgasm"),
    ("sexual", "horny wives want you tonight"), ("sexual", "i will do anything you like in bed"), ("sexual", "lick me slowly"), ("sexual", "she rode him until he climaxed"), ("sexual", "sie trieben es nackt und stöhnend die ganze nacht"),
    ("sexual", "ils ont baisé nus toute la nuit"), ("sexual", "follaron desnudos toda la noche"),
    # scientific, technical and reporting use of such words, and plain criticism
    ("", "the parent process may kill the child process"), ("", "a race condition between two threads"), ("", "the dead load and the live load act on the beam"), ("", "the villagers complained of vermin in the barn"),
    ("", "rats were weighed each week and killed humanely"), ("", "the naked singularity is hidden"), ("", "nude mice received the drug"), ("", "sex and age of the patients were recorded"), ("", "sexual selection in birds"),
    ("", "breast cancer screening"), ("", "the classifier finds insults such as idiot in comments"), ("", "we study hate speech against foreigners in forums"), ("", "a historical term for intellectual disability was moron"),
    ("", "in the play the king calls his son a bastard"), ("", "the proof in section two is wrong"), ("", "this plot is ugly, please redraw it"), ("", "the referee is mistaken here"), ("", "this argument is useless and should be removed"),
    ("", "the cock is opened to drain the tank"), ("", "the interviewed mothers were residents"), ("", "foreigners were asked about their rent"), ("", "people inside the house could not breathe because of smoke"), ("", "parasites in fish"),
    ("", "the inferior vena cava"), ("", "contraception and sex education at school"), ("", "images with adult content were filtered"), ("", "a stupid baseline works well"), ("", "weeds such as bastard cabbage"), ("", "das nackte auge sieht nichts"),
    ("", "ungeziefer im getreide wurde gezählt"), ("", "la vermine du grenier"), ("", "las ratas fueron alimentadas"), ("", "le fil nu touche la table"), ("", "der stumme sensor"), ("", "la basura fue recogida"),
]
