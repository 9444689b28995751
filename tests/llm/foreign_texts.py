"""Passages written by hand, unlike the documents and the made-up training sentences; places are marked [[kind:...]]."""

PASSAGES = [
    "Dear [[person:Theodora Blackwell-Nash]], we regret to inform you that your booking at our hotel could not be confirmed. Please ring [[phone:020 7946 0321]] or write to [[email:front.desk@grandpalace-hotel.co.uk]] before Friday.",
    "The tenancy agreement between [[person:Cornelius Abernathy]] and [[person:Rosalind Petrakis]] concerns the flat at [[address:18 Larkspur Avenue, Tunbridge Wells TN4 8QD]]. Rent is 940 pounds a month.",
    "Customer wrote: my parcel never arrived at [[address:2207 Juniper Ridge Road, Boulder, CO 80304]], can someone call me on [[phone:(303) 555-0188]]? Thanks, [[person:Dashiell Monroe]]",
    "Employee file. Name [[person:Marguerite Fontanelle]]. Social security number [[id_number:512-88-3046]]. Starts on 1 March. Salary band 7, desk 4412.",
    "Police report 2023/8841: the witness, Mr. [[person:Okonkwo]], stated that the driver fled on foot. Reference number 77-1203 was assigned.",
    "School newsletter: Mrs. [[person:Pemberton]] will retire in July after 31 years. A collection is held in room 12.",
    "I met Dr. [[person:Wu]] at the conference; the talk on Gaussian mixtures began at 9:30 in hall B2.",
    "From: [[person:Leopold Sturgis]] <[[email:leo.sturgis77@webmail.org]]>\nSubject: Re: invoice 20881\nThe amount of 4,512.00 was paid on 3 May.",
    "For questions contact [[email:helpdesk (at) city-library (dot) org]]. Opening hours are 10:00-18:00, closed on Mondays.",
    "The passenger presented passport number [[id_number:X4471902]] at the gate. Flight LX 318 departed at 07:45 with 164 people.",
    "Quarterly revenue rose by 12.5% to 48.3 million. The board approved resolution 2024-17 without dissent.",
    "Install version 3.12.4, then run the script with --seed 20240101. Checksums: 9f86d081, 884c7d65.",
    "Obituary: [[person:Winifred Okoro-Lindqvist]] passed away peacefully at St. Brigid Hospital. Flowers may be sent to [[address:5 Rectory Close, Ely]].",
    "Voicemail from [[person:Ezekiel Thornquist]], please return his call on [[phone:+1 415 555 0134]] tomorrow.",
    "The Bechdel test and the Richter scale were mentioned in chapter 4. Nobody cited page 212.",
    "Insurance card: member ID [[id_number:884-213-907]], holder [[person:Philippa Drummond]], group 5512.",
    "hey its [[person:marcus delacroix]], new number is [[phone:07911 123456]], old one is dead",
    "Delivery note: 14 boxes of item 556-7781-02 to warehouse 3. Signed by [[person:B. Hollingsworth]].",
    "Her brother [[person:Ignatius Varga]] lives at [[address:77b Cobbler's Lane, Whitby]] and works nights.",
    "Court of appeal, docket 19-4471. Counsel for the claimant: [[person:Augustina Merriweather]]. The hearing lasted 45 minutes.",
    "Chère Madame [[person:Castelnau]], votre dossier est complet. Vous pouvez nous joindre au [[phone:04 72 19 88 35]] ou par courriel à [[email:accueil@mairie-belleroche.fr]].",
    "Le contrat est établi au nom de [[person:Anselme Vaillancourt]], demeurant [[address:14 rue des Tanneurs, 21000 Dijon]]. Numéro de police 4471-B.",
    "Monsieur [[person:Ferrand]] a perdu son passeport n° [[id_number:19FV44821]] à la gare. Le train 6607 avait 20 minutes de retard.",
    "La réunion du conseil aura lieu le 14 mars à 18 h 30 en salle 204. Ordre du jour : budget et travaux.",
    "Bonjour, je suis [[person:Solène Kerguelen]] et je cherche un appartement vers [[address:8 boulevard Carnot, 59800 Lille]]. Mon portable : [[phone:06 44 61 20 97]].",
    "Le théorème de Rolle et la loi de Benford sont au programme de l'examen 2024.",
    "Sehr geehrter Herr [[person:Achterberg]], Ihre Bestellung 88-4410 ist unterwegs. Bei Fragen erreichen Sie uns unter [[phone:0221 4778812]].",
    "Der Mietvertrag mit [[person:Wilhelmine Oberndorfer]], [[address:Fasanenweg 12, 76131 Karlsruhe]], endet am 30. Juni.",
    "Bewerbung von [[person:Thorben Quast]], geboren am 4.5.1991, E-Mail [[email:t.quast@posteo-mail.de]], Personalausweis [[id_number:L8F1T39K2]].",
    "Die Sitzung beginnt um 14 Uhr in Raum 317. Tagesordnungspunkt 5 entfällt.",
    "Frau Dr. [[person:Eisenbarth]] vertritt den Kollegen bis Montag. Das Fourier-Spektrum wurde nicht ausgewertet.",
    "Estimado señor [[person:Valdivieso]], su reserva 7710-C está confirmada. Puede escribir a [[email:reservas@hostal-luna.es]] o llamar al [[phone:952 447 013]].",
    "El contrato lo firma [[person:Encarnación Robledo]], con DNI [[id_number:48113907K]], domiciliada en [[address:Calle de los Herreros 22, 18009 Granada]].",
    "La profesora [[person:Remedios Cifuentes]] presentó el libro en la sala 3 ante 120 asistentes.",
    "El índice de Gini fue de 0,34 y la tasa del 7,2 % según el informe 2023-11.",
    "Ship order 99182 to [[person:Bartholomew Crane]], [[address:Unit 6, 300 Harbor View Drive, Portland 97205]]; tracking 1Z 999 AA1.",
    "Lost dog! Call [[person:Henrietta Falk]] on [[phone:555-0142]] if you have seen him near the mill.",
    "The study by the Rowett group enrolled 2,310 adults; identifier NCT04419012, grant R01-551822.",
    "Ms [[person:Ng]] and Mr [[person:Featherstonehaugh]] sat in row 14. The show lasted two hours.",
    "Please update my address to [[address:901 Sycamore Terrace, Apt 4, Duluth]] and my email to [[email:h_falk@northshore.net]].",
]
