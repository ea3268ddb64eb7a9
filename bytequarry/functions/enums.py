"""Code-to-name domains of the formats, as data.

A domain is text: a code, then names of that code and the following ones; a later number starts a new run.
``domain(name)`` gives (code, name) pairs, ``enum_table(spark)`` all of them as a dimension table.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["DOMAINS", "codes", "domain", "enum_table", "name_of", "names"]

# The formats' codes and the names that users know.
DOMAINS = {
    "ELF_CLASS": "0 CLASSNONE CLASS32 CLASS64",
    "ELF_DATA": "0 NONE LSB MSB",
    "ELF_OSABI": "0 SYSV HPUX 255 STANDALONE",
    "ELF_ET": "0 NONE REL EXEC DYN CORE 0xfe00 LOOS 0xfeff HIOS 0xff00 LOPROC 0xffff HIPROC",
    "ELF_EM": """0 NONE M32 SPARC ~386 68K 88K 486 860 MIPS S370 MIPS_RS3_LE RS6000 UNKNOWN12 UNKNOWN13 UNKNOWN14 PA_RISC nCUBE VPP500 SPARC32PLUS
        960 PPC PPC64 S390 SPE UNKNOWN24 UNKNOWN25 UNKNOWN26 UNKNOWN27 UNKNOWN28 UNKNOWN29 UNKNOWN30 UNKNOWN31 UNKNOWN32 UNKNOWN33 UNKNOWN34
        UNKNOWN35 V800 FR20 RH32 RCE ARM ALPHA SH SPARCV9 TRICORE ARC H8_300 H8_300H H8S H8_500 IA_64 MIPS_X COLDFIRE 68HC12 MMA PCP NCPU NDR1
        STARCORE ME16 ST100 TINYJ AMD64 PDSP UNKNOWN64 UNKNOWN65 FX66 ST9PLUS ST7 68HC16 68HC11 68HC08 68HC05 SVX ST19 VAX CRIS JAVELIN FIREPATH
        ZSP MMIX HUANY PRISM AVR FR30 D10V D30V V850 M32R MN10300 MN10200 PJ OPENRISC ARC_A5 XTENSA""",
    "ELF_EV": "0 NONE CURRENT",
    "ELF_PT": """0 NULL LOAD DYNAMIC INTERP NOTE SHLIB PHDR TLS 0x60000000 LOOS 0x6464e550 UNWIND 0x6474e550 EH_FRAME GNU_STACK GNU_RELRO
        0x6fff0000 OS_SCE 0x6fffffff HIOS 0x70000000 LOPROC 0x7fffffff HIPROC""",
    "ELF_PF": "1 X 2 W 4 R 0xf0000000 MASKPROC",
    "ELF_SHN": "0 UNDEF 0xff00 LOPROC 0xff1f HIPROC 0xff20 LOOS 0xff3f HIOS 0xfff1 ABS COMMON 0xffff HIRESERVE",
    "ELF_SHT": """0 NULL PROGBITS SYMTAB STRTAB RELA HASH DYNAMIC NOTE NOBITS REL SHLIB DYNSYM 0x60000000 LOOS 0x6fffffff HIOS 0x70000000 LOPROC
        0x700000a4 PS3_RELA 0x7fffffff HIPROC 0x80000000 LOUSER 0xffffffff HIUSER""",
    "ELF_SHF": "1 WRITE 2 ALLOC 4 EXECINSTR 0x0f000000 MASKOS 0xf0000000 MASKPROC",
    "ELF_STT": "0 NOTYPE OBJECT FUNC SECTION FILE 10 LOOS 12 HIOS LOPROC 15 HIPROC",
    "ELF_STB": "0 LOCAL GLOBAL WEAK 10 LOOS 12 HIOS LOPROC 15 HIPROC",
    "ELF_STV": "0 DEFAULT HIDDEN PROTECTED",
    "ELF_DT": """0 DT_NULL DT_NEEDED DT_PLTRELSZ DT_PLTGOT DT_HASH DT_STRTAB DT_SYMTAB DT_RELA DT_RELASZ DT_RELAENT DT_STRSZ DT_SYMENT DT_INIT DT_FINI
        DT_SONAME DT_RPATH DT_SYMBOLIC DT_REL DT_RELSZ DT_RELENT DT_PLTREL DT_DEBUG DT_TEXTREL DT_JMPREL DT_BIND_NOW DT_INIT_ARRAY DT_FINI_ARRAY
        DT_INIT_ARRAYSZ DT_FINI_ARRAYSZ DT_RUNPATH DT_FLAGS 32 DT_ENCODING DT_PREINIT_ARRAYSZ 0x6000000d DT_LOOS 0x6ffff000 DT_HIOS
        0x70000000 DT_LOPROC 0x7fffffff DT_HIPROC""",
    "RELOC_386": """0 R_386_NONE R_386_32 R_386_PC32 R_386_GOT32 R_386_PLT32 R_386_COPY R_386_GLOB_DAT R_386_JMP_SLOT R_386_RELATIVE R_386_GOTOFF
        R_386_GOTPC R_386_32PLT R_386_TLS_GD_PLT R_386_TLS_LDM_PLT R_386_TLS_TPOFF R_386_TLS_IE R_386_TLS_GOTIE R_386_TLS_LE R_386_TLS_GD
        R_386_TLS_LDM R_386_16 R_386_PC16 R_386_8 R_386_PC8 R_386_UNKNOWN24 R_386_UNKNOWN25 R_386_UNKNOWN26 R_386_UNKNOWN27 R_386_UNKNOWN28
        R_386_UNKNOWN29 R_386_UNKNOWN30 R_386_UNKNOWN31 R_386_TLS_LDO_32 R_386_UNKNOWN33 R_386_UNKNOWN34 R_386_TLS_DTPMOD32 R_386_TLS_DTPOFF32
        R_386_UNKNOWN37 R_386_SIZE32 R_386_NUM""",
    "RELOC_PPC": """0 R_PPC_NONE R_PPC_ADDR32 R_PPC_ADDR24 R_PPC_ADDR16 R_PPC_ADDR16_LO R_PPC_ADDR16_HI R_PPC_ADDR16_HA R_PPC_ADDR14
        R_PPC_ADDR14_BRTAKEN R_PPC_ADDR14_BRNTAKEN R_PPC_REL24 R_PPC_REL14 R_PPC_REL14_BRTAKEN R_PPC_REL14_BRNTAKEN R_PPC_GOT16 R_PPC_GOT16_LO
        R_PPC_GOT16_HI R_PPC_GOT16_HA R_PPC_PLTREL24 R_PPC_COPY R_PPC_GLOB_DAT R_PPC_JMP_SLOT R_PPC_RELATIVE R_PPC_LOCAL24PC R_PPC_UADDR32
        R_PPC_UADDR16 R_PPC_REL32 R_PPC_PLT32 R_PPC_PLTREL32 R_PPC_PLT16_LO R_PPC_PLT16_HI R_PPC_PLT16_HA R_PPC_SDAREL16 R_PPC_SECTOFF
        R_PPC_SECTOFF_LO R_PPC_SECTOFF_HI R_PPC_SECTOFF_HA R_PPC_ADDR30
        67 R_PPC_TLS R_PPC_DTPMOD32 R_PPC_TPREL16 R_PPC_TPREL16_LO R_PPC_TPREL16_HI R_PPC_TPREL16_HA R_PPC_TPREL32 R_PPC_DTPREL16
        R_PPC_DTPREL16_LO R_PPC_DTPREL16_HI R_PPC_DTPREL16_HA R_PPC_DTPREL32 R_PPC_GOT_TLSGD16 R_PPC_GOT_TLSGD16_LO R_PPC_GOT_TLSGD16_HI
        R_PPC_GOT_TLSGD16_HA R_PPC_GOT_TLSLD16 R_PPC_GOT_TLSLD16_LO R_PPC_GOT_TLSLD16_HI R_PPC_GOT_TLSLD16_HA R_PPC_GOT_TPREL16
        R_PPC_GOT_TPREL16_LO R_PPC_GOT_TPREL16_HI R_PPC_GOT_TPREL16_HA R_PPC_GOT_DTPREL16 R_PPC_GOT_DTPREL16_LO R_PPC_GOT_DTPREL16_HI
        R_PPC_GOT_DTPREL16_HA
        101 R_PPC_EMB_NADDR32 R_PPC_EMB_NADDR16 R_PPC_EMB_NADDR16_LO R_PPC_EMB_NADDR16_HI R_PPC_EMB_NADDR16_HA R_PPC_EMB_SDAI16
        R_PPC_EMB_SDA2I16 R_PPC_EMB_SDA2REL R_PPC_EMB_SDA21 R_PPC_EMB_MRKREF R_PPC_EMB_RELSEC16 R_PPC_EMB_RELST_LO R_PPC_EMB_RELST_HI
        R_PPC_EMB_RELST_HA R_PPC_EMB_BIT_FLD R_PPC_EMB_RELSDA""",
    "RELOC_PPC64": """0 R_PPC64_NONE R_PPC64_ADDR32 R_PPC64_ADDR24 R_PPC64_ADDR16 R_PPC64_ADDR16_LO R_PPC64_ADDR16_HI R_PPC64_ADDR16_HA R_PPC64_ADDR14
        R_PPC64_ADDR14_BRTAKEN R_PPC64_ADDR14_BRNTAKEN R_PPC64_REL24 R_PPC64_REL14 R_PPC64_REL14_BRTAKEN R_PPC64_REL14_BRNTAKEN R_PPC64_GOT16
        R_PPC64_GOT16_LO R_PPC64_GOT16_HI R_PPC64_GOT16_HA 19 R_PPC64_COPY R_PPC64_GLOB_DAT R_PPC64_JMP_SLOT R_PPC64_RELATIVE
        24 R_PPC64_UADDR32 R_PPC64_UADDR16 R_PPC64_REL32 R_PPC64_PLT32 R_PPC64_PLTREL32 R_PPC64_PLT16_LO R_PPC64_PLT16_HI R_PPC64_PLT16_HA
        33 R_PPC64_SECTOFF R_PPC64_SECTOFF_LO R_PPC64_SECTOFF_HI R_PPC64_SECTOFF_HA R_PPC64_REL30 R_PPC64_ADDR64 R_PPC64_ADDR16_HIGHER
        R_PPC64_ADDR16_HIGHERA R_PPC64_ADDR16_HIGHEST R_PPC64_ADDR16_HIGHESTA R_PPC64_UADDR64 R_PPC64_REL64 R_PPC64_PLT64 R_PPC64_PLTREL64
        R_PPC64_TOC16 R_PPC64_TOC16_LO R_PPC64_TOC16_HI R_PPC64_TOC16_HA R_PPC64_TOC R_PPC64_PLTGOT16 R_PPC64_PLTGOT16_LO R_PPC64_PLTGOT16_HI
        R_PPC64_PLTGOT16_HA R_PPC64_ADDR16_DS R_PPC64_ADDR16_LO_DS R_PPC64_GOT16_DS R_PPC64_GOT16_LO_DS R_PPC64_PLT16_LO_DS R_PPC64_SECTOFF_DS
        R_PPC64_SECTOFF_LO_DS R_PPC64_TOC16_DS R_PPC64_TOC16_LO_DS R_PPC64_PLTGOT16_DS R_PPC64_PLTGOT16_LO_DS R_PPC64_TLS R_PPC64_DTPMOD64
        R_PPC64_TPREL16 R_PPC64_TPREL16_LO R_PPC64_TPREL16_HI R_PPC64_TPREL16_HA R_PPC64_TPREL64 R_PPC64_DTPREL16 R_PPC64_DTPREL16_LO
        R_PPC64_DTPREL16_HI R_PPC64_DTPREL16_HA R_PPC64_DTPREL64 R_PPC64_GOT_TLSGD16 R_PPC64_GOT_TLSGD16_LO R_PPC64_GOT_TLSGD16_HI
        R_PPC64_GOT_TLSGD16_HA R_PPC64_GOT_TLSLD16 R_PPC64_GOT_TLSLD16_LO R_PPC64_GOT_TLSLD16_HI R_PPC64_GOT_TLSLD16_HA R_PPC64_GOT_TPREL16_DS
        R_PPC64_GOT_TPREL16_LO_DS R_PPC64_GOT_TPREL16_HI R_PPC64_GOT_TPREL16_HA R_PPC64_GOT_DTPREL16_DS R_PPC64_GOT_DTPREL16_LO_DS
        R_PPC64_GOT_DTPREL16_HI R_PPC64_GOT_DTPREL16_HA R_PPC64_TPREL16_DS R_PPC64_TPREL16_LO_DS R_PPC64_TPREL16_HIGHER R_PPC64_TPREL16_HIGHERA
        R_PPC64_TPREL16_HIGHEST R_PPC64_TPREL16_HIGHESTA R_PPC64_DTPREL16_DS R_PPC64_DTPREL16_LO_DS R_PPC64_DTPREL16_HIGHER
        R_PPC64_DTPREL16_HIGHERA R_PPC64_DTPREL16_HIGHEST R_PPC64_DTPREL16_HIGHESTA 253 R_PPC64_GNU_VTINHERIT R_PPC64_GNU_VTENTRY""",
    "RELOC_AMD64": """0 R_AMD64_NONE R_AMD64_64 R_AMD64_PC32 R_AMD64_GOT32 R_AMD64_PLT32 R_AMD64_COPY R_AMD64_GLOB_DAT R_AMD64_JUMP_SLOT R_AMD64_RELATIVE
        R_AMD64_GOTPCREL R_AMD64_32 R_AMD64_32S R_AMD64_16 R_AMD64_PC16 R_AMD64_8 R_AMD64_PC8 R_AMD64_DTPMOD64 R_AMD64_DTPOFF64 R_AMD64_TPOFF64
        R_AMD64_TLSGD R_AMD64_TLSLD R_AMD64_DTPOFF32 R_AMD64_GOTTPOFF R_AMD64_TPOFF32 R_AMD64_PC64 R_AMD64_GOTOFF64 R_AMD64_GOTPC32 R_AMD64_GOT64
        R_AMD64_GOTPCREL64 R_AMD64_GOTPC64 R_AMD64_GOTPLT64 R_AMD64_PLTOFF64 R_AMD64_SIZE32 R_AMD64_SIZE64 R_AMD64_GOTPC32_TLSDESC
        R_AMD64_TLSDESC_CALL R_AMD64_TLSDESC R_AMD64_IRELATIVE 250 R_AMD64_GNU_VTINHERIT R_AMD64_GNU_VTENTRY""",
    "COFF_MACHINE": """0 UNKNOWN 0x14c I386 0x166 R4000 0x169 WCEMIPSV2 0x1a2 SH3 SH3DSP 0x1a6 SH4 0x1a8 SH5 0x1c0 ARM 0x1c2 THUMB 0x1c4 ARMV7 0x1d3 AM33
        0x1f0 POWERPC POWERPCFP 0x200 IA64 0x266 MIPS16 0x366 MIPSFPU 0x466 MIPSFPU16 0xebc EBC 0x8664 AMD64 0x9041 M32R""",
    "PE_SECTION": """0x8 TYPE_NO_PAD 0x20 CNT_CODE 0x40 CNT_INITIALIZED_DATA 0x80 CNT_UNINITIALIZED_DATA 0x100 LNK_OTHER 0x200 LNK_INFO 0x800 LNK_REMOVE
        0x1000 LNK_COMDAT 0x8000 GPREL 0x20000 MEM_16BIT 0x40000 MEM_LOCKED 0x80000 MEM_PRELOAD 0xf00000 ALIGN 0x1000000 LNK_NRELOC_OVFL
        0x2000000 MEM_DISCARDABLE 0x4000000 MEM_NOT_CACHED 0x8000000 MEM_NOT_PAGED 0x10000000 MEM_SHARED 0x20000000 MEM_EXECUTE
        0x40000000 MEM_READ 0x80000000 MEM_WRITE""",
    "PE_MAGIC": "0x101 TARGET 0x104 OBJ 0x107 ROM 0x10b NT32 0x123 HOST 0x20b NT64",
    "PE_DLL": """0x40 DYNAMIC_BASE 0x80 FORCE_INTEGRITY 0x100 NX_COMPAT 0x200 NO_ISOLATION 0x400 NO_SEH 0x800 NO_BIND 0x2000 WDM_DRIVER
        0x8000 TERMINAL_SERVER_AWARE""",
    "PE_DIRECTORY": """0 EXPORT IMPORT RESOURCE EXCEPTION SECURITY BASERELOC DEBUG_DIR ARCHITECTURE GLOBALPTR TLS LOAD_CONFIG BOUND_IMPORT IAT
        DELAY_IMPORT CLR_DESCRIPTOR""",
    "PE_RESOURCE": """0 NONE CURSOR BITMAP ICON MENU DIALOG STRING FONTDIR FONT ACCELERATOR RCDATA MESSAGETABLE GROUP_CURSOR 14 GROUP_ICON 16 VERSION
        DLGINCLUDE 19 PLUGPLAY VXD ANICURSOR ANIICON HTML MANIFEST 241 TOOLBAR""",
    "CLR_HEAP": "0 String GUID Blob UserString",
    "CLR_FLAGS": """0x1 FLAGS_ILONLY 0x2 FLAGS_32BITREQUIRED 0x4 FLAGS_IL_LIBRARY 0x8 FLAGS_STRONGNAMESIGNED 0x10 FLAGS_NATIVE_ENTRYPOINT
        0x10000 FLAGS_TRACKDEBUGDATA""",
    "CLR_TABLE": """0 Module TypeRef TypeDef 4 Field 6 MethodDef 8 Param InterfaceImpl MemberRef Constant CustomAttribute FieldMarshal DeclSecurity
        ClassLayout FieldLayout StandAloneSig EventMap 0x14 Event PropertyMap 0x17 Property MethodSemantics MethodImpl ModuleRef TypeSpec ImplMap
        FieldRVA 0x20 Assembly AssemblyProcessor AssemblyOS AssemblyRef AssemblyRefProcessor AssemblyRefOS File ExportedType ManifestResource
        NestedClass GenericParam MethodSpec GenericParamConstraint""",
    "MACH_FILETYPE": "1 OBJECT EXECUTE FVMLIB CORE PRELOAD DYLIB DYLINKER BUNDLE DYLIB_STUB DSYM KEXT_BUNDLE FILESET",
    "MACH_CPU": """1 VAX 6 MC680x0 X86 MIPS 10 MC98000 HPPA ARM MC88000 SPARC I860 ALPHA 18 POWERPC 0x01000000 ARCH_64 0x01000007 X86_64
        0x0100000c ARM_64 0x01000012 POWERPC_64 0xff000000 ARCH_MASK 0xffffffff ANY""",
    "MACH_SUB_VAX": "0 VAX_ALL VAX780 VAX785 VAX750 VAX730 UVAXI UVAXII VAX8200 VAX8500 VAX8600 VAX8650 VAX8800 UVAXIII",
    "MACH_SUB_MC680x0": "1 MC680x0_ALL 1 MC68030 MC68040 MC68030_ONLY",
    "MACH_SUB_X86": "3 X86_ALL 3 X86_64_ALL X86_ARCH1",
    "MACH_SUB_MIPS": "0 MIPS_ALL MIPS_R2300 MIPS_R2600 MIPS_R2800 MIPS_R2000a MIPS_R2000 MIPS_R3000a MIPS_R3000",
    "MACH_SUB_MC98000": "0 MC98000_ALL MC98601",
    "MACH_SUB_HPPA": "0 HPPA_ALL 0 HPPA_7100 HPPA_7100LC",
    "MACH_SUB_ARM": "0 ARM_ALL 5 ARM_V4T ARM_V6 ARM_V5TEJ ARM_XSCALE ARM_V7 11 ARM_V7S ARM_V7K 14 ARM_V6M ARM_V7M ARM_V7EM",
    "MACH_SUB_MC88000": "0 MC88000_ALL MC88100 MC88110",
    "MACH_SUB_SPARC": "0 SPARC_ALL",
    "MACH_SUB_I860": "0 I860_ALL I860_860",
    "MACH_SUB_POWERPC": """0 POWERPC_ALL POWERPC_601 POWERPC_602 POWERPC_603 POWERPC_603e POWERPC_603ev POWERPC_604 POWERPC_604e POWERPC_620 POWERPC_750
        POWERPC_7400 POWERPC_7450 100 POWERPC_970""",
    "MACH_SUB_X86_64": """3 I386_ALL 3 I386 I486 0x84 I486SX 5 I586 5 PENT 0x16 PENTPRO 0x36 PENTII_M3 0x56 PENTII_M5 0x67 CELERON 0x77 CELERON_MOBILE
        8 PENTIUM_3 0x18 PENTIUM_3_M 0x28 PENTIUM_3_XEON 9 PENTIUM_M PENTIUM_4 0x1a PENTIUM_4_M 0xb ITANIUM 0x1b ITANIUM_2 0xc XEON 0x1c XEON_MP""",
    "MACH_SUB_ARM_64": "0 ARM64_ALL ARM64_V8 ARM64E 0x01000000 FEATURE 0x80000000 LIB64",
    "MACH_FLAGS": """0x1 NOUNDEFS 0x2 INCRLINK 0x4 DYLDLINK 0x8 BINDATLOAD 0x10 PREBOUND 0x20 SPLIT_SEGS 0x40 LAZY_INIT 0x80 TWOLEVEL 0x100 FORCE_FLAT
        0x200 NOMULTIDEFS 0x400 NOFIXPREBINDING 0x800 PREBINDABLE 0x1000 ALLMODSBOUND 0x2000 SUBSECTIONS_VIA_SYMBOLS 0x4000 CANONICAL
        0x8000 WEAK_DEFINES 0x10000 BINDS_TO_WEAK 0x20000 ALLOW_STACK_EXECUTION 0x40000 ROOT_SAFE 0x80000 SETUID_SAFE
        0x100000 NO_REEXPORTED_DYLIBS 0x200000 PIE 0x400000 DEAD_STRIPPABLE_DYLIB 0x800000 HAS_TLV_DESCRIPTORS 0x1000000 NO_HEAP_EXECUTION""",
    "MACH_CMD": """1 SEGMENT SYMTAB SYMSEG THREAD UNIXTHREAD LOADFVMLIB IDFVMLIB 9 FVMFILE 0xb DYSYMTAB LOAD_DYLIB ID_DYLIB LOAD_DYLINKER ID_DYLINKER
        PREBOUND_DYLIB ROUTINES SUB_FRAMEWORK SUB_UMBRELLA SUB_CLIENT SUB_LIBRARY TWOLEVEL_HINTS PREBIND_CKSUM 0x80000018 LOAD_WEAK_DYLIB
        0x19 SEGMENT_64 ROUTINES_64 UUID 0x8000001c RPATH 0x1d CODE_SIGNATURE SEGMENT_SPLIT_INFO 0x8000001f REEXPORT_DYLIB 0x20 LAZY_LOAD_DYLIB
        ENCRYPTION_INFO DYLD_INFO 0x80000022 DYLD_INFO_ONLY LOAD_UPWARD_DYLIB 0x24 VERSION_MIN_MACOSX VERSION_MIN_IPHONEOS FUNCTION_STARTS
        DYLD_ENVIRONMENT 0x80000028 MAIN 0x29 DATA_IN_CODE SOURCE_VERSION DYLIB_CODE_SIGN_DRS ENCRYPTION_INFO_64 LINKER_OPTION
        LINKER_OPTIMIZATION_HINT VERSION_MIN_TVOS VERSION_MIN_WATCHOS NOTE BUILD_VERSION 0x80000033 DYLD_EXPORTS_TRIE DYLD_CHAINED_FIXUPS""",
    "MACH_SEGMENT": "1 HIGHVM 2 FVMLIB 4 NORELOC 8 PROTECTED_VERSION_1",
    "MACH_SECTION": """0 REGULAR ZEROFILL CSTRING_LITERALS LITERALS4 LITERALS8 LITERAL_POINTERS NON_LAZY_SYMBOL_POINTERS LAZY_SYMBOL_POINTERS SYMBOL_STUBS
        MOD_INIT_FUNC_POINTERS MOD_TERM_FUNC_POINTERS COALESCED GB_ZEROFILL INTERPOSING LITERALS16 DTRACE_DOF LAZY_DYLIB_SYMBOL_POINTERS
        THREAD_LOCAL_REGULAR THREAD_LOCAL_ZEROFILL THREAD_LOCAL_VARIABLES THREAD_LOCAL_VARIABLE_POINTERS THREAD_LOCAL_INIT_FUNCTION_POINTERS""",
    "MACH_SECTION_SYS": "1 LOC_RELOC 2 EXT_RELOC 4 SOME_INSTRUCTIONS",
    "MACH_SECTION_USR": "2 DEBUG 4 SELF_MODIFYING_CODE 8 LIVE_SUPPORT 16 NO_DEAD_STRIP 32 STRIP_STATIC_SYMS 64 NO_TOC 128 PURE_INSTRUCTIONS",
    "MACH_NTYPE": "0 UNDF ABS 5 INDR PBUD SECT",
    "MACH_NREF": "0 UNDEFINED_NON_LAZY UNDEFINED_LAZY DEFINED PRIVATE_DEFINED PRIVATE_UNDEFINED_NON_LAZY PRIVATE_UNDEFINED_LAZY",
    "MACH_NFLAGS": "1 ARM_THUMB_DEF 2 REF_DYNAMIC 4 NO_DEAD_STRIP 8 WEAK_REF 16 WEAK_DEF",
    "MACH_INDIRECT": "0x40000000 INDIRECT_SYMBOL_ABS 0x80000000 INDIRECT_SYMBOL_LOCAL",
    "MACH_REBASE": """0 DONE SET_TYPE_IMM SET_SEGMENT_AND_OFFSET_ULEB ADD_ADDR_ULEB ADD_ADDR_IMM_SCALED DO_REBASE_IMM_TIMES DO_REBASE_ULEB_TIMES
        DO_REBASE_ADD_ADDR_ULEB DO_REBASE_ULEB_TIMES_SKIPPING_ULEB""",
    "MACH_BIND": """0 DONE SET_DYLIB_ORDINAL_IMM SET_DYLIB_ORDINAL_ULEB SET_DYLIB_SPECIAL_IMM SET_SYMBOL_TRAILING_FLAGS_IMM SET_TYPE_IMM SET_ADDEND_SLEB
        SET_SEGMENT_AND_OFFSET_ULEB ADD_ADDR_ULEB DO_BIND DO_BIND_ADD_ADDR_ULEB DO_BIND_ADD_ADDR_IMM_SCALED DO_BIND_ULEB_TIMES_SKIPPING_ULEB""",
    "MACH_DYLD_KIND": "0 KIND_REGULAR KIND_THREAD_LOCAL KIND_ABSOLUTE KIND_MASK WEAK_DEFINITION 8 REEXPORT 16 STUB_AND_RESOLVER",
    "MACH_TOOL": "1 CLANG SWIFT LD LLD",
    "MACH_PLATFORM": "1 MACOS IOS TVOS WATCHOS BRIDGEOS MACCATALYST IOSSIMULATOR TVOSSIMULATOR WATCHOSSIMULATOR DRIVERKIT",
    "MACH_POINTER": """1 ARM64E ~64 32 32_CACHE 32_FIRMWARE 64_OFFSET ARM64E_KERNEL 64_KERNEL_CACHE ARM64E_USERLAND ARM64E_FIRMWARE X86_64_KERNEL_CACHE
        ARM64E_USERLAND24""",
    "MACH_PAGE": "0x8000 MULTI 0x8000 LAST 0xffff NONE",
    "MACH_IMPORTS": "1 IMPORT IMPORT_ADDEND IMPORT_ADDEND64",
    "MACH_SYMBOLS": "0 UNCOMPRESSED ZLIB",
    "MACH_DICE": "1 DATA JUMP_TABLE8 JUMP_TABLE16 JUMP_TABLE32 ABS_JUMP_TABLE32",
    "CFB_SECTOR": "-4 MSAT SAT ENDOFCHAIN FREE",
    "CFB_TYPE": "0 Empty UserStorage UserStream LockBytes Property RootStorage",
    "CV_PRMODE": "0 TM_DIRECT TM_NPTR TM_FPTR TM_HPTR TM_NPTR32 TM_FPTR32 TM_NPTR64 TM_NPTR128",
    "CV_TYPE": "0 SPECIAL SIGNED UNSIGNED BOOLEAN REAL COMPLEX SPECIAL2 INT 15 CVRESERVED",
    "CV_SPECIAL": "0 SP_NOTYPE SP_ABS SP_SEGMENT SP_VOID SP_CURRENCY SP_NBASICSTR SP_FBASICSTR SP_NOTTRANS SP_HRESULT",
    "CV_LEAF": """1 LF_MODIFIER_16t LF_POINTER_16t LF_ARRAY_16t LF_CLASS_16t LF_STRUCTURE_16t LF_UNION_16t LF_ENUM_16t LF_PROCEDURE_16t LF_MFUNCTION_16t
        LF_VTSHAPE LF_COBOL0_16t LF_COBOL1 LF_BARRAY_16t LF_LABEL LF_NULL LF_NOTTRAN LF_DIMARRAY_16t LF_VFTPATH_16t LF_PRECOMP_16t LF_ENDPRECOMP
        LF_OEM_16t LF_TYPESERVER_ST 0x1000 LF_TI16_MAX LF_MODIFIER LF_POINTER LF_ARRAY_ST LF_CLASS_ST LF_STRUCTURE_ST LF_UNION_ST LF_ENUM_ST
        LF_PROCEDURE LF_MFUNCTION 0x100f LF_ALIAS_ST 0x1503 LF_ARRAY LF_CLASS LF_STRUCTURE LF_UNION LF_ENUM 0x150a LF_ALIAS 0x1516 LF_STRIDED_ARRAY
        0x151b LF_VECTOR LF_MATRIX 0x8000 LF_CHAR LF_SHORT LF_USHORT LF_LONG LF_ULONG LF_REAL32 LF_REAL64 LF_REAL80 LF_REAL128 LF_QUADWORD
        LF_UQUADWORD 0x8019 LF_DECIMAL LF_DATE""",
    "CV_PTRTYPE": """0 PTR_NEAR PTR_FAR PTR_HUGE PTR_BASE_SEG PTR_BASE_VAL PTR_BASE_SEGVAL PTR_BASE_ADDR PTR_BASE_SEGADDR PTR_BASE_TYPE PTR_BASE_SELF
        PTR_NEAR32 PTR_FAR32 PTR_64 PTR_UNUSEDPTR""",
    "CV_PTRMODE": "0 PTR_MODE_PTR PTR_MODE_REF PTR_MODE_PMEM PTR_MODE_PMFUNC PTR_MODE_RVREF PTR_MODE_RESERVED",
    "CV_PMTYPE": """0 PMTYPE_Undef PMTYPE_D_Single PMTYPE_D_Multiple PMTYPE_D_Virtual PMTYPE_D_General PMTYPE_F_Single PMTYPE_F_Multiple PMTYPE_F_Virtual
        PMTYPE_F_General""",
    "CV_HFA": "0 none float double other",
    "CV_MOCOM": "0 NONAME ref Value interface",
    "CV_SYMBOL": """1 S_COMPILE S_REGISTER_16t S_CONSTANT_16t S_UDT_16t S_SSEARCH S_END S_SKIP S_CVRESERVE S_OBJNAME_ST S_ENDARG S_COBOLUDT_16t
        S_MANYREG_16t S_RETURN S_ENTRYTHIS 0x100 S_BPREL16 S_LDATA16 S_GDATA16 S_PUB16 S_LPROC16 S_GPROC16 S_THUNK16 S_BLOCK16 S_WITH16 S_LABEL16
        S_CEXMODEL16 S_VFTABLE16 S_REGREL16 0x200 S_BPREL32_16t S_LDATA32_16t S_GDATA32_16t S_PUB32_16t S_LPROC32_16t S_GPROC32_16t S_THUNK32_ST
        S_BLOCK32_ST S_WITH32_ST S_LABEL32_ST S_CEXMODEL32 S_VFTABLE32_16t S_REGREL32_16t S_LTHREAD32_16t S_GTHREAD32_16t S_SLINK32
        0x300 S_LPROCMIPS_16t S_GPROCMIPS_16t 0x400 S_PROCREF_ST S_DATAREF_ST S_ALIGN S_LPROCREF_ST S_OEM 0x1000 S_TI16_MAX S_REGISTER_ST
        S_CONSTANT_ST S_UDT_ST S_COBOLUDT_ST S_MANYREG_ST S_BPREL32_ST S_LDATA32_ST S_GDATA32_ST S_PUB32_ST S_LPROC32_ST S_GPROC32_ST S_VFTABLE32
        S_REGREL32_ST S_LTHREAD32_ST S_GTHREAD32_ST S_LPROCMIPS_ST S_GPROCMIPS_ST S_FRAMEPROC S_COMPILE2_ST S_MANYREG2_ST S_LPROCIA64_ST
        S_GPROCIA64_ST S_LOCALSLOT_ST S_PARAMSLOT_ST S_ANNOTATION S_GMANPROC_ST S_LMANPROC_ST S_RESERVED1 S_RESERVED2 S_RESERVED3 S_RESERVED4
        S_LMANDATA_ST S_GMANDATA_ST S_MANFRAMEREL_ST S_MANREGISTER_ST S_MANSLOT_ST S_MANMANYREG_ST S_MANREGREL_ST S_MANMANYREG2_ST S_MANTYPREF
        S_UNAMESPACE_ST 0x1100 S_ST_MAX S_OBJNAME S_THUNK32 S_BLOCK32 S_WITH32 S_LABEL32 S_REGISTER S_CONSTANT S_UDT S_COBOLUDT S_MANYREG
        S_BPREL32 S_LDATA32 S_GDATA32 S_PUB32 S_LPROC32 S_GPROC32 S_REGREL32 S_LTHREAD32 S_GTHREAD32 S_LPROCMIPS S_GPROCMIPS S_COMPILE2 S_MANYREG2
        S_LPROCIA64 S_GPROCIA64 S_LOCALSLOT S_PARAMSLOT S_LMANDATA S_GMANDATA S_MANFRAMEREL S_MANREGISTER S_MANSLOT S_MANMANYREG S_MANREGREL
        S_MANMANYREG2 S_UNAMESPACE S_PROCREF S_DATAREF S_LPROCREF S_ANNOTATIONREF S_TOKENREF S_GMANPROC S_LMANPROC S_TRAMPOLINE S_MANCONSTANT
        S_ATTR_FRAMEREL S_ATTR_REGISTER S_ATTR_REGREL S_ATTR_MANYREG S_SEPCODE S_LOCAL_2005 S_DEFRANGE_2005 S_DEFRANGE2_2005 S_SECTION S_COFFGROUP
        S_EXPORT S_CALLSITEINFO S_FRAMECOOKIE S_DISCARDED S_COMPILE3 S_ENVBLOCK S_LOCAL S_DEFRANGE S_DEFRANGE_SUBFIELD S_DEFRANGE_REGISTER
        S_DEFRANGE_FRAMEPOINTER_REL S_DEFRANGE_SUBFIELD_REGISTER S_DEFRANGE_FRAMEPOINTER_REL_FULL_SCOPE S_DEFRANGE_REGISTER_REL S_LPROC32_ID
        S_GPROC32_ID S_LPROCMIPS_ID S_GPROCMIPS_ID S_LPROCIA64_ID S_GPROCIA64_ID S_BUILDINFO S_INLINESITE S_INLINESITE_END S_PROC_ID_END
        S_DEFRANGE_HLSL S_GDATA_HLSL S_LDATA_HLSL S_FILESTATIC 0x1159 S_ARMSWITCHTABLE S_CALLEES S_CALLERS S_POGODATA S_INLINESITE2
        S_HEAPALLOCSITE S_MOD_TYPEREF S_REF_MINIPDB S_PDBMAP S_GDATA_HLSL32 S_LDATA_HLSL32 S_GDATA_HLSL32_EX S_LDATA_HLSL32_EX 0x1167 S_FASTLINK
        S_INLINEES S_RECTYPE_MAX 0x1269 S_RECTYPE_PAD""",
    "CV_SUBSECTION": """0xf1 SYMBOLS LINES STRINGTABLE FILECHKSMS FRAMEDATA INLINEELINES CROSSSCOPEIMPORTS CROSSSCOPEEXPORTS 0x80000000 IGNORE""",
    "CV_PROCFLAG": """0x1 PFLAG_NOFPO 0x2 PFLAG_INT 0x4 PFLAG_FAR 0x8 PFLAG_NEVER 0x10 PFLAG_NOTREACHED 0x20 PFLAG_CUST_CALL 0x40 PFLAG_NOINLINE
        0x80 PFLAG_OPTDBGINFO""",
}

#: Domains whose names may look like numbers: in these a run's further words are names whatever they look like.
_NUMERIC_NAMES = {"ELF_EM", "MACH_POINTER"}


@cache
def domain(name: str) -> tuple[tuple[int, str], ...]:
    """(code, name) in the order of the text."""
    out, code = [], None
    for word in DOMAINS[name].split():
        number = word.lstrip("-")[:1].isdigit() and (name not in _NUMERIC_NAMES or code is None)
        if number:
            code = int(word, 0)
        else:
            out.append((code, word.lstrip("~")))
            code += 1
    return tuple(out)


def codes(name: str) -> dict[str, int]:
    return {n: c for c, n in domain(name)}


def names(name: str) -> dict[int, str]:
    """Code -> its first name."""
    out: dict[int, str] = {}
    for c, n in domain(name):
        out.setdefault(c, n)
    return out


def name_of(value: Column, name: str) -> Column:
    """The name of a code by a literal map; null for unknown codes."""
    pairs = [x for c, n in names(name).items() for x in (F.lit(c).cast("bigint"), F.lit(n))]
    return F.try_element_at(F.create_map(*pairs), value.cast("bigint"))


def enum_table(spark: SparkSession) -> DataFrame:
    """domain, code, name, rank: all domains; rank 1 is the first name of a code."""
    rows = []
    for d in DOMAINS:
        seen: dict[int, int] = {}
        for c, n in domain(d):
            seen[c] = seen.get(c, 0) + 1
            rows.append((d, c, n, seen[c]))
    return spark.createDataFrame(rows, "domain string, code bigint, name string, rank int")
