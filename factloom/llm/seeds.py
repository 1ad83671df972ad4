"""Authored example passages, 1 for abusive and 0 for harmless, that start the fit where few documents were reviewed."""

from __future__ import annotations

#: Written for this package, in the languages of the corpus.
SEEDS = [
    ("You are a complete idiot.", 1), ("What a stupid moron you are.", 1), ("Shut your mouth, loser.", 1), ("You worthless piece of garbage.", 1),
    ("Nobody likes you, just leave.", 1), ("Go kill yourself.", 1), ("I will hurt you and your family.", 1), ("I am going to find you and beat you up.", 1),
    ("You deserve to die.", 1), ("I hope you get hit by a car.", 1), ("We will burn your house down.", 1), ("You will pay for this when we meet.", 1),
    ("Immigrants are animals.", 1), ("Women are too dumb for this job.", 1), ("All foreigners are criminals, kick them out.", 1), ("Those people are vermin.", 1),
    ("Gays are disgusting and do not belong here.", 1), ("Disabled people are a burden and should be locked away.", 1), ("Send me naked pictures of you.", 1), ("I want to have sex with you.", 1),
    ("Watch hot girls live, free porn.", 1), ("Let me see your body, baby.", 1), ("I want to undress you tonight.", 1), ("Your face makes me sick, you fool.", 1),
    ("Du bist ein Idiot.", 1), ("Halt den Mund, du Arschloch.", 1), ("Ich bringe dich um.", 1), ("Ausländer sind Dreck und sollen verschwinden.", 1), ("Frauen gehören an den Herd.", 1), ("Schick mir Nacktfotos.", 1), ("Ich will mit dir ins Bett.", 1), ("Stirb endlich, du Versager.", 1),
    ("Tu es un idiot complet.", 1), ("Ferme-la, connard.", 1), ("Je vais te tuer.", 1), ("Les immigrés sont des parasites.", 1), ("Les femmes sont trop bêtes pour coder.", 1), ("Envoie-moi tes photos nue.", 1), ("J'ai envie de toi dans mon lit.", 1), ("Crève, personne ne t'aime.", 1),
    ("Eres un idiota.", 1), ("Cállate, imbécil.", 1), ("Te voy a matar.", 1), ("Los inmigrantes son basura.", 1), ("Las mujeres son demasiado tontas.", 1), ("Mándame fotos sin ropa.", 1), ("Quiero acostarme contigo.", 1), ("Muérete, nadie te quiere.", 1),
    ("お前は本当に馬鹿だ。", 1), ("死ね、ゴミ。", 1), ("お前を殺してやる。", 1), ("外国人は害虫だ、出て行け。", 1), ("女は台所にいろ。", 1), ("裸の写真を見せろ。", 1), ("お前と寝たい。", 1), ("クズは消えろ。", 1),
    ("This code is stupid and ugly.", 0), ("The build is a damn mess again.", 0), ("I am such an idiot, I forgot the semicolon.", 0), ("My own stupid mistake, sorry.", 0), ("Kill the child process first.", 0), ("The parent process dies before the child.", 0),
    ("The dead branch was removed.", 0), ("This function is dumb but fast.", 0), ("The sex column holds a code.", 0), ("Gender and sex are optional fields.", 0), ("We count women and men separately.", 0), ("The refugees data set has new rows.", 0),
    ("Please report insults and threats to us.", 0), ("The word filter blocks the term idiot.", 0), ("The policy forbids hate speech.", 0), ("Black and white lists were renamed.", 0), ("The master and slave nodes were renamed.", 0), ("Abort and kill the job.", 0),
    ("The naked pointer leaks.", 0), ("The nude theme has a new colour.", 0), ("Execute the hook after the merge.", 0), ("I hate this bug.", 0), ("Fuck, the test fails again.", 0), ("This damn parser drives me crazy.", 0),
    ("Thank you for your review.", 0), ("You should run the analysis again.", 0), ("Your patch touches many files.", 0), ("Can you look at this?", 0), ("Could you please fix the docs?", 0), ("I think you are right about the lock.", 0),
    ("Ich Idiot habe den Test vergessen.", 0), ("Der verdammte Build ist kaputt.", 0), ("Der Kindprozess muss getötet werden.", 0), ("Danke für dein Review.", 0), ("Die Spalte für das Geschlecht fehlt.", 0), ("Kannst du dir das ansehen?", 0),
    ("Quel idiot je fais, j'ai oublié le test.", 0), ("Ce foutu script est lent.", 0), ("Il faut tuer le processus.", 0), ("Merci pour ta relecture.", 0), ("Tu peux relancer l'analyse ?", 0), ("La colonne sexe est vide.", 0),
    ("Qué idiota soy, olvidé la prueba.", 0), ("Este maldito código es lento.", 0), ("Hay que matar el proceso hijo.", 0), ("Gracias por tu revisión.", 0), ("¿Puedes ejecutar el análisis?", 0), ("La columna sexo está vacía.", 0),
    ("自分が馬鹿だった、テストを忘れた。", 0), ("このコードはひどい。", 0), ("子プロセスを殺す。", 0), ("レビューありがとうございます。", 0), ("性別の列は空です。", 0), ("解析をもう一度お願いします。", 0),
    ("The caller owns the returned buffer and must release it.", 0), ("Ownership passes to the caller.", 0), ("Falls back to the default when the configuration has no entry.", 0), ("Returns the first item whose size exceeds the limit.", 0), ("Blocks until all workers have arrived.", 0),
    ("Raises an error if the file was closed.", 0), ("Write me later.", 0), ("Walks the tree and drops what was seen before.", 0), ("The cache is rebuilt whenever the key changes.", 0), ("Reverted because the cache returned wrong rows under load.", 0),
    ("Gibt das erste Element zurück, das größer als die Grenze ist.", 0), ("Renvoie le premier élément sans modifier l'original.", 0), ("Devuelve el elemento más antiguo y descarta el resto.", 0), ("指定した要素を走査して返す。", 0), ("Not safe to call from a signal handler.", 0),
    ("Checks the index, then the table, then the file.", 0), ("The layer imports the module below it.", 0), ("Keeps the order in which the items were added.", 0), ("Used by the exporter to print the raw value.", 0), ("Idempotent: calling it twice changes nothing.", 0),
]
